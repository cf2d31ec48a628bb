"""Vocabulary and sequence features.

vocab_fit      every word → index (1 = OOV, words from 2 by count desc, ties by
               first appearance), with word and document counts
encode         tokens → indices (unknown or index ≥ num_words → OOV)
pad            post-pad / post-truncate to a fixed length with 0
one_hot        label id → 0/1 array
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.constants import EMOTIONS, MAX_SEQ_LEN, OOV_INDEX, PAD_INDEX, VOCAB_NUM_WORDS
from moodframe.functions.text import tokenize
from moodframe.operators.indexing import with_row_numbers
from moodframe.operators.partitioning import materialised


def words(df: DataFrame, text_col: str = "clean_text") -> DataFrame:
    """(word): every token."""
    # the ``_outer`` form infers no size filter that would be pushed into the text expression
    return df.select(F.explode_outer(tokenize(text_col)).alias("word")).filter(F.col("word").isNotNull())


def word_stats(df: DataFrame, key: str, text_col: str = "clean_text") -> DataFrame:
    """(word, word_count, doc_count, first): counts, and the first row (least
    ``key``) with the word's place among that row's distinct words.

    A document is one row, so its distinct words are found inside it: they are
    appended to its tokens, and a place beyond the tokens counts the document.
    All tokens are combined by word before the one shuffle, by word.
    """
    both = df.select(key, tokenize(text_col).alias("t")).select(key, F.size("t").alias("n"), F.concat("t", F.array_distinct("t")).alias("t"))
    each = both.select(key, "n", F.posexplode_outer("t").alias("at", "word")).filter(F.col("word").isNotNull())
    marks = F.col("at") >= F.col("n")
    whole = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole:
        # one number that orders as (key, place); min of a struct would sort all tokens
        first = F.min(F.when(marks, F.col(key).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(12,0)") + (F.col("at") - F.col("n"))))
    else:
        first = F.min(F.when(marks, F.struct(F.col(key).alias("k"), (F.col("at") - F.col("n")).alias("p"))))
    return each.groupBy("word").agg(
        F.sum((~marks).cast("int")).alias("word_count"), F.sum(marks.cast("int")).alias("doc_count"), first.alias("first")
    )


def vocab_fit(train: DataFrame, key: str, text_col: str = "clean_text") -> DataFrame:
    """All words with their index, from 2 by count descending, ties by first
    appearance.  The numbers come from a range partition, not a global window;
    how many of them an encoder uses is the encoder's choice."""
    stats = word_stats(train, key, text_col).withColumn("_n", F.negative("word_count"))
    numbered = with_row_numbers(materialised(stats, "word-stats"), ["_n", "first"], "index", 2)
    return numbered.select(
        "word",
        F.col("index").cast("int").alias("index"),
        F.col("word_count").cast("bigint").alias("word_count"),
        F.col("doc_count").cast("bigint").alias("doc_count"),
    )


def vocab_size(train: DataFrame, key: str, text_col: str = "clean_text", num_words: int = VOCAB_NUM_WORDS) -> DataFrame:
    """min(num_words, distinct words + 2): the embedding input size."""
    n = words(train, text_col).distinct().agg(F.count(F.lit(1)).alias("n_words"))
    return n.select(
        F.col("n_words").cast("bigint").alias("n_words"),
        F.least(F.lit(num_words).cast("bigint"), F.col("n_words") + 2).alias("vocab_size"),
    )


def encoder(vocab: DataFrame, num_words: int = VOCAB_NUM_WORDS):
    """An Arrow function from arrays of tokens to arrays of ids: unknown words
    and words numbered ``num_words`` or more become the OOV number.

    At most ``num_words`` rows of ``vocab`` are collected and broadcast.  A
    batch's tokens meet the dictionary in one vectorised lookup, so a text is
    encoded inside its row and no token is shuffled.
    """
    known = vocab.filter(F.col("index") < num_words).select("word", F.col("index").cast("int").alias("index")).toArrow().combine_chunks()
    shared = vocab.sparkSession.sparkContext.broadcast((known["word"].combine_chunks(), known["index"].combine_chunks()))

    @F.arrow_udf("array<int>")
    def ids(tokens: pa.Array) -> pa.Array:
        word, index = shared.value
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        found = pc.fill_null(index.take(pc.index_in(tokens.flatten(), value_set=word)), OOV_INDEX)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found.cast(pa.int32()))

    return ids


def encode(
    df: DataFrame, vocab: DataFrame, key: str, text_col: str = "clean_text", max_len: int | None = None, num_words: int = VOCAB_NUM_WORDS
) -> DataFrame:
    """(key, ids) with ids in token order (see ``encoder``); a text without
    tokens has none.  With ``max_len`` only the first so many tokens are coded,
    which is post-truncation, as every token has exactly one id."""
    tokens = F.coalesce(tokenize(text_col), F.array().cast("array<string>"))
    tokens = tokens if max_len is None else F.slice(tokens, 1, max_len)
    return df.select(key, encoder(vocab, num_words)(tokens).alias("ids"))


def pad(ids: Column | str, max_len: int = MAX_SEQ_LEN) -> Column:
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(F.concat(c, F.array_repeat(F.lit(PAD_INDEX), max_len)), 1, max_len)


def one_hot(label: Column | str, n: int = len(EMOTIONS)) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == c, 1.0).otherwise(0.0))
