"""Lexicon as data: the keyword table and its join on containment.

The wide expression form (``moodframe.functions.scoring``) is faster for the
fixed lexicon; the join form takes any caller-supplied lexicon table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.constants import BASE_TENTHS, EMOTIONS, KEYWORDS, keyword_weight
from moodframe.operators.partitioning import materialised

#: Up to so many keywords each text is tested against the broadcast lexicon;
#: beyond, texts' grams probe an index of the lexicon.
BROADCAST_KEYWORDS = 1_000
#: Length of the grams that a large lexicon is filed under.
GRAM = 4


def lexicon_table(spark: SparkSession) -> DataFrame:
    rows = [
        (i, e, kw, keyword_weight(e, kw))
        for i, e in enumerate(EMOTIONS)
        for kw in KEYWORDS[e]
    ]
    return spark.createDataFrame(rows, "label_id int, emotion string, keyword string, weight int")


def grams(text: Column | str, n: int) -> Column:
    """The distinct substrings of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _all_grams(text: str, lengths: list[int]) -> Column:
    return F.explode_outer(F.concat(*[grams(text, n) for n in lengths])) if len(lengths) > 1 else F.explode_outer(grams(text, lengths[0]))


def gram_index(words: DataFrame, probes: DataFrame, n: int = GRAM) -> DataFrame:
    """(gram, keyword, labels): each keyword under the one of its grams that the
    fewest texts hold, a keyword of fewer than ``n`` characters under itself.

    ``probes`` has a row (gram) for each text and distinct gram.  Only grams of
    the lexicon are counted, and those that no text holds count 0, so a keyword
    that cannot occur costs nothing.
    """
    labels = F.collect_list(F.struct("emotion", "weight")).alias("labels")
    each = words.groupBy("keyword").agg(labels)
    short = each.filter(F.length("keyword") <= n).select(F.col("keyword").alias("gram"), "keyword", "labels")
    long = each.filter(F.length("keyword") > n)
    parts = long.select("keyword", F.explode_outer(grams("keyword", n)).alias("gram"))
    held = probes.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    seen = parts.join(held, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = seen.groupBy("keyword").agg(F.min(F.struct("texts", "gram")).alias("best"))
    return long.join(rarest, "keyword").select(F.col("best.gram").alias("gram"), "keyword", "labels").unionByName(short)


def contained(cleaned: DataFrame, keys: list[str], lexicon: DataFrame, broadcast_keywords: int = BROADCAST_KEYWORDS, n: int = GRAM) -> DataFrame:
    """(keys, emotion, weight) for every keyword found in a text, once each.

    A small lexicon is broadcast and the texts stream past it.  A larger one is
    filed under rare grams (``gram_index``): a text probes the index once for
    each of its distinct grams, and only the keywords that it meets there are
    looked for in it.  Grams are of one length, besides the lengths of keywords
    that are shorter still.  A gram that stands in nearly every text is seldom
    the rarest of a keyword; where it is, its join partition is an ordinary one
    that AQE can split.
    """
    words = lexicon.select("emotion", "keyword", "weight").filter(F.length("keyword") > 0)
    if words.count() <= broadcast_keywords:
        j = cleaned.select(*keys, "cleaned_text").join(F.broadcast(words), F.col("cleaned_text").contains(F.col("keyword")))
        return j.select(*keys, "emotion", "weight")
    lengths = sorted(r[0] for r in words.select(F.least(F.length("keyword"), F.lit(n))).distinct().collect())  # <= n numbers
    texts = materialised(cleaned.select(*keys, "cleaned_text", F.monotonically_increasing_id().alias("_row")), "lexicon-texts")
    probes = texts.select("_row", _all_grams("cleaned_text", lengths).alias("gram"))
    index = materialised(gram_index(words, probes, n), "lexicon-index")
    met = probes.join(index, "gram").select("_row", "keyword", "labels")
    found = met.join(texts, "_row").filter(F.col("cleaned_text").contains(F.col("keyword")))
    return found.select(*keys, F.inline("labels"))


def keyword_hits(spark: SparkSession, cleaned: DataFrame, keys: list[str], lexicon: DataFrame | None = None, broadcast_keywords: int = BROADCAST_KEYWORDS) -> DataFrame:
    """(keys, emotion, n_hits, tenths) for every text and every label, labels
    without a hit included at the base weight."""
    lex = lexicon if lexicon is not None else lexicon_table(spark)
    hits = contained(cleaned, keys, lex, broadcast_keywords).groupBy(*keys, "emotion").agg(
        F.count(F.lit(1)).alias("n_hits"), F.sum("weight").alias("weight")
    )
    # the labels are few by nature: they ride along as an array, without a join
    labels = [r[0] for r in lex.select("emotion").distinct().collect()] if lexicon is not None else EMOTIONS
    every = cleaned.select(*keys, F.explode(F.array(*[F.lit(e) for e in sorted(labels)])).alias("emotion"))
    return every.join(hits, [*keys, "emotion"], "left").select(
        *keys,
        "emotion",
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
        (F.lit(BASE_TENTHS) + F.coalesce("weight", F.lit(0))).alias("tenths"),
    )
