"""Labelled-dataset jobs: normalise and filter labels, clean text for
training, encode labels, exact stratified train/validation split.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodframe.functions.constants import (
    CSV_NULL_TOKENS,
    DEFAULT_STOP_WORDS,
    EMOTIONS,
    NOUN_SUFFIX_RULES,
    SPLIT_SEED,
    VALIDATION_SIZE,
)
from moodframe.functions.text import basic_clean, lemmatize_tokens, tokenize, trim_ws
from moodframe.operators.partitioning import fenced, materialised, spread

log = logging.getLogger(__name__)


def null_tokens_to_null(col: str, tokens: list[str] = CSV_NULL_TOKENS) -> Column:
    """Map CSV null tokens ('NA', 'None', 'null', …) to NULL, as pandas does."""
    return F.when(F.col(col).isin(tokens), F.lit(None).cast("string")).otherwise(F.col(col))


def normalize_label(col: Column | str) -> Column:
    """strip (all Unicode whitespace) + title case."""
    return F.initcap(F.lower(trim_ws(col)))


def label_id(col: Column | str) -> Column:
    """Label → id 0..6 in label order (NULL when unsupported).

    Seven fixed labels: an array lookup replaces a join to the dimension."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.array_position(F.array(*[F.lit(e) for e in EMOTIONS]), c) - 1).cast("int")


def supported_labels(df: DataFrame, col: str = "emotion") -> DataFrame:
    out = df.filter(F.col(col).isin(EMOTIONS))
    if out.isEmpty():
        raise ValueError(f"none of the rows carries one of the labels {', '.join(EMOTIONS)}")
    return out


def corpus_lemma_table(tokens: DataFrame, token_col: str = "tokens") -> DataFrame:
    """(surface, lemma) derived from the corpus itself: a word maps to the
    shortest of itself and the noun-suffix candidates that occur as words in
    the corpus (ties by rule order).  Only changed words are returned.

    Distinct words are one shuffle by word; candidates join back to them by
    an equi-join (shuffle by candidate).
    """
    words = tokens.select(F.explode_outer(token_col).alias("word")).distinct().filter(F.col("word").isNotNull())
    rules = F.array(
        *[F.struct(F.lit(i + 1).alias("r"), F.lit(s).alias("suf"), F.lit(rep).alias("rep")) for i, (s, rep) in enumerate(NOUN_SUFFIX_RULES)]
    )
    cands = words.select("word", F.explode(rules).alias("rule")).filter(
        F.col("word").endswith(F.col("rule.suf")) & (F.length("word") > F.length("rule.suf"))
    )
    cands = cands.select(
        "word",
        F.col("rule.r").alias("r"),
        F.concat(F.expr("substring(word, 1, length(word) - length(rule.suf))"), F.col("rule.rep")).alias("cand"),
    )
    valid = cands.join(words.select(F.col("word").alias("cand")), "cand")
    best = valid.groupBy("word").agg(F.min_by("cand", F.struct(F.length("cand"), F.col("r"))).alias("lemma"))
    return best.filter(F.length("lemma") < F.length("word")).select(F.col("word").alias("surface"), "lemma")


def drop_stop_words(df: DataFrame, key, tokens_col: str, stop_words: list[str] = DEFAULT_STOP_WORDS) -> DataFrame:
    """Remove stop words keeping order and duplicates.  MLlib's transformer
    filters against a hash set on the JVM (a per-token lambda would run
    interpreted)."""
    from pyspark.ml.feature import StopWordsRemover

    remover = StopWordsRemover(inputCol=tokens_col, outputCol="_kept", stopWords=list(stop_words), caseSensitive=True)
    keys = [key] if isinstance(key, str) else list(key)
    return remover.transform(df.select(*keys, tokens_col)).select(*keys, F.col("_kept").alias(tokens_col))


def check_stop_words(stop_words: list[str]) -> None:
    """Raise, before any job runs, on a stop list that cannot be meant."""
    bad = [w for w in stop_words if not isinstance(w, str) or not w or w != w.strip()]
    if not stop_words or bad:
        raise ValueError(f"stop list is empty or holds blank or padded words: {bad[:5]}")


def check_lemmas(lemmas: DataFrame) -> None:
    """Raise on a lemma table without its columns, with nulls, or with two
    lemmas for one surface."""
    missing = {"surface", "lemma"} - set(lemmas.columns)
    if missing:
        raise ValueError(f"lemma table lacks {sorted(missing)}")
    per = lemmas.groupBy("surface").agg(F.count_distinct("lemma").alias("n"), F.count(F.when(F.col("lemma").isNull(), 1)).alias("nulls"))
    bad = per.filter((F.col("n") > 1) | (F.col("nulls") > 0) | F.col("surface").isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"lemma table is ambiguous or has nulls for: {[r['surface'] for r in bad]}")


def training_tokens(df: DataFrame, keep: list[str], text_col: str = "text", stop_words: list[str] | None = DEFAULT_STOP_WORDS) -> DataFrame:
    """(keep, tokens) after cleaning and stop-word removal."""
    cols = list(dict.fromkeys([*keep, text_col]))
    toks = spread(df.select(*cols)).select(*keep, fenced(tokenize(basic_clean(text_col))).alias("tokens"))
    if stop_words is None:
        return toks
    check_stop_words(stop_words)
    return drop_stop_words(toks, keep, "tokens", stop_words)


def training_text(
    df: DataFrame,
    key: str,
    text_col: str = "text",
    stop_words: list[str] | None = DEFAULT_STOP_WORDS,
    lemmas: DataFrame | str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """(key, *keep, clean_text) with stop-word removal and optional lemma lookup.

    ``keep`` columns ride along (no self-join needed to get them back).
    ``lemmas`` is a (surface, lemma) table, ``"corpus"`` for the table derived
    from these very texts, or None: then the lemma step is the identity."""
    columns = list(dict.fromkeys([key, *(keep or [])]))
    toks = training_tokens(df, columns, text_col, stop_words)
    if lemmas is None:
        log.info("no lemma table given: lemmatisation is the identity")
    else:
        toks = materialised(toks, "tokens")  # read by the lemma table and by the lookup
        if isinstance(lemmas, str):
            lemmas = materialised(corpus_lemma_table(toks), "lemmas")
        else:
            check_lemmas(lemmas)
        toks = lemmatize_tokens(toks, key, "tokens", lemmas)
    return toks.select(*columns, fenced(F.array_join("tokens", " ")).alias("clean_text"))


def prepare_dataset(
    raw: DataFrame,
    key: str = "row_id",
    stop_words: list[str] | None = DEFAULT_STOP_WORDS,
    lemmas: DataFrame | str | None = None,
    check_nonempty: bool = True,
    text: bool = True,
) -> DataFrame:
    """(row_id, text, emotion, clean_text, label): drop nulls, normalise and
    filter labels (raising when none is supported), clean, drop empty text,
    encode the label.  Without ``text`` the raw text is read and cleaned but
    not carried along."""
    d = raw.select(key, "text", null_tokens_to_null("emotion").alias("emotion"))
    d = d.withColumn("text", null_tokens_to_null("text")).dropna(subset=["text", "emotion"])
    d = d.withColumn("emotion", normalize_label("emotion"))
    d = supported_labels(d) if check_nonempty else d.filter(F.col("emotion").isin(EMOTIONS))
    shown = ["text"] if text else []
    cleaned = training_text(d, key, "text", stop_words, lemmas, keep=[*shown, "emotion"])
    kept = cleaned.filter(F.length("clean_text") > 0)
    return kept.select(key, *shown, "emotion", "clean_text", label_id("emotion").alias("label"))


# ---------------------------------------------------------------------------
# Exact stratified split
# ---------------------------------------------------------------------------


def split_hash(key: str, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def split_quotas(df: DataFrame, validation_size: float = VALIDATION_SIZE, label_col: str = "label") -> DataFrame:
    """Per label: n, n_train quota, n_val quota, and whether stratified.

    n_val = ceil(size·n), n_train = n − n_val.  Train seats per class are
    floor(c/n·n_train) plus one for the largest remainders (lower label on
    ties).  Input here is the per-label count table (≤ 7 rows), so the
    windows below are over a handful of rows.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c"))
    w_all = Window.partitionBy(F.lit(1))
    n = F.sum("c").over(w_all)
    c = counts.select(
        label_col,
        "c",
        n.alias("n"),
        F.min("c").over(w_all).alias("c_min"),
        F.count(F.lit(1)).over(w_all).alias("k"),
    )
    c = c.withColumn("n_val_total", F.ceil(F.lit(float(validation_size)) * F.col("n")).cast("bigint"))
    c = c.withColumn("n_train_total", F.col("n") - F.col("n_val_total"))
    cont = F.col("c").cast("double") / F.col("n").cast("double") * F.col("n_train_total").cast("double")
    c = c.withColumn("cont", cont).withColumn("base", F.floor("cont").cast("bigint"))
    c = c.withColumn("rem", F.col("cont") - F.col("base"))
    leftover = F.col("n_train_total") - F.sum("base").over(w_all)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("rem").desc(), F.col(label_col)))
    c = c.withColumn("train_q", F.col("base") + F.when(rank <= leftover, 1).otherwise(0))
    return c.select(
        label_col,
        "c",
        "n",
        "k",
        (F.col("c_min") >= 2).alias("stratified"),
        "n_val_total",
        "n_train_total",
        F.col("train_q").cast("bigint").alias("train_q"),
    )


#: Hex digits of the hash that one round of the selection looks at, and the
#: rows of a class among which the cut is then taken directly.
DIGITS, FEW = 3, 64


def split_cuts(h: DataFrame, key: str, label_col: str | None, wanted: dict) -> dict:
    """For each class the (hash, key) of its last row among the ``wanted`` first
    by (hash, key); None where none is wanted.

    A class's rows are counted by the first digits of the hash, only the bin
    that holds the cut is counted by the next digits, and so on until a bin is
    small: each round is one partly aggregated count, of at most 16^DIGITS rows
    a class, and no row is moved or sorted.
    """
    own = F.col(label_col) if label_col else F.lit(0)
    left = {c: n for c, n in wanted.items() if n > 0}
    cuts = dict.fromkeys(wanted)
    prefix, size = dict.fromkeys(left, ""), {}
    depth = 0
    while any(size.get(c, FEW + 1) > FEW for c in left) and depth < 32:
        open_bins = [c for c in left if size.get(c, FEW + 1) > FEW]
        depth += DIGITS
        here = _any((own == F.lit(c)) & F.col("_h").startswith(prefix[c]) for c in open_bins)
        counts = h.filter(here).groupBy(own.alias("c"), F.substring("_h", 1, depth).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        by_class: dict = {}
        for r in counts:
            by_class.setdefault(r["c"], []).append((r["bin"], r["n"]))
        for c in open_bins:
            for name, n in sorted(by_class[c]):
                if n >= left[c]:
                    prefix[c], size[c] = name, n
                    break
                left[c] -= n
    if left:
        here = _any((own == F.lit(c)) & F.col("_h").startswith(prefix[c]) for c in left)
        rows: dict = {}
        for r in h.filter(here).select(own.alias("c"), "_h", F.col(key).alias("k")).distinct().collect():  # <= FEW rows a class
            rows.setdefault(r["c"], []).append((r["_h"], r["k"]))
        for c, found in rows.items():
            cuts[c] = sorted(found)[min(left[c], len(found)) - 1]
    return cuts


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _up_to(cut, key: str) -> Column:
    if cut is None:
        return F.lit(False)
    return (F.col("_h") < cut[0]) | ((F.col("_h") == cut[0]) & (F.col(key) <= F.lit(cut[1])))


def split_stratified(
    df: DataFrame,
    key: str = "row_id",
    label_col: str = "label",
    validation_size: float = VALIDATION_SIZE,
    seed: int = SPLIT_SEED,
) -> DataFrame:
    """Adds ``split`` ∈ {train, validation} with exact per-class sizes.

    Row order inside a class is md5(seed|key).  The last training row of each
    class is found by a distributed selection (``split_cuts``), and every row
    is then told by comparing it with its class's: rows are neither sorted nor
    joined.  ``key`` identifies a row; rows that repeat it fall on one side.
    When the smallest class has fewer than two rows the split is not
    stratified: the first n_val rows by hash go to validation.
    """
    # the input is written once; everything below reads it
    h = materialised(df.withColumn("_h", split_hash(key, seed)), "split-input")
    q = split_quotas(h, validation_size, label_col).collect()  # ≤ 7 rows: one per label
    if not q:
        return df.withColumn("split", F.lit(None).cast("string"))
    n_val, n_train, k = q[0]["n_val_total"], q[0]["n_train_total"], q[0]["k"]
    if q[0]["stratified"]:
        if n_val < k or n_train < k:
            raise ValueError(
                f"validation ({n_val}) and train ({n_train}) sizes must be at least the number of classes ({k})"
            )
        cuts = split_cuts(h, key, label_col, {r[label_col]: r["train_q"] for r in q})
        train = _any((F.col(label_col) == F.lit(c)) & _up_to(cut, key) for c, cut in cuts.items())
        return h.select(*df.columns, F.when(train, "train").otherwise("validation").alias("split"))
    cut = split_cuts(h, key, None, {0: n_val})[0]
    return h.select(*df.columns, F.when(_up_to(cut, key), "validation").otherwise("train").alias("split"))
