"""Mixing sources to target weights by pivotal dependent rounding.

Sources by code point (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the
total number of words.  A target stops at ``max_repeats`` times its source's
words and the excess is shared again by weight (water filling, in closed
form).  A document's expected copies are target / source words: the whole part
is taken for sure, the fractional part is rounded by the pivotal method.  Two
documents exchange mass, measured in words, until one of them is integral; the
direction is drawn so that each document keeps its expected copies, and the
words of the pair never change.  So a source misses its target by less than
one document.

Distribution: documents are dealt by hash into leaves of about ``leaf_rows``
rows per source; each leaf runs the pivotal pass over its documents from the
longest down and leaves at most one fractional document.  Those residuals are
combined in a tree of ``fan_in`` leaves a node until one is left per source.
That last one goes to the nearer side, which keeps the source closer to its
target; all other documents keep their expected copies exactly.  Leaves, order
and draws depend only on the rows and ``seed``, so reruns agree.

Defined results: null or blank text has size 0 and is taken 0 words (0
copies); null source is a source of its own, last; repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.store import written

#: Equal rows that are made again in one go.
RUN = 4096
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """The ``row`` of ``mix_sources``."""
    return F.xxhash64(doc_id, source.cast("string"), words(text))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, size) rows.

    Water level: with sources ordered by cap / weight, the first ``k`` are at
    their caps for the ``k`` where the level reached by the rest lies between
    the two caps.  The windows run over one row per source.
    """
    agg = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = agg.withColumn("weight", pick.cast("double")).withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    level = (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before"))
    w = w.select("*", level.alias("level"), F.row_number().over(order).alias("k"))
    below = F.col("level") * F.col("weight") < F.col("cap")
    first = F.min(F.when(below, F.struct("k", "level"))).over(everything)
    target = F.when(first.isNull() | (F.col("k") < first["k"]), F.col("cap")).otherwise(first["level"] * F.col("weight"))
    return w.select("source", "n_docs", "source_size", target.alias("target"))


def pivotal(share: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``share`` (each in 0..1) in order; the words of the pair in hand
    are kept.  Returns the shares and the index still fractional, or -1."""
    p = share.astype(float).copy()
    eps = 1e-9
    held = -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = round(p[i])
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words moved from b to a
        down = min(p[a] * size[a], (1 - p[b]) * size[b])  # words moved from a to b
        move = up if draws[i] * (up + down) < down else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        held = -1
        for k in (a, b):
            if p[k] <= eps or p[k] >= 1 - eps:
                p[k] = round(p[k])
            else:
                held = k
    return p, held


def _rng(*key) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "little"))


def _round_group(pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """One pivotal pass over a group, from the longest document down."""
    pdf = pdf.sort_values(["size", "row", "nth"], ascending=[False, True, True], kind="stable")
    first = pdf.iloc[0]
    key = (seed, level, None if pd.isna(first["source"]) else first["source"], int(first["node"]))
    pdf["share"], held = pivotal(pdf["share"].to_numpy(), pdf["size"].to_numpy(float), _rng(*key))
    pdf["open"] = False
    if held >= 0:
        pdf.iloc[held, pdf.columns.get_loc("open")] = True
    return pdf


def counted_rows(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, size, row) with ``nth``, which numbers equal
    ones from 0.  They are counted first and made again from their count, in
    runs of ``RUN``, so that no task holds all rows without an id."""
    counts = rows.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("n"))
    run = F.lit(RUN)
    runs = counts.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / run))).alias("run"))
    dealt = runs.repartition(F.xxhash64("row", "run"))
    nth = F.explode(F.sequence(F.col("run") * run, F.least(F.col("n"), (F.col("run") + 1) * run) - 1))
    return dealt.select("doc_id", "source", "size", "row", nth.alias("nth"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    leaf_rows: int = 4096,
    fan_in: int = 64,
    seed: int = 9,
) -> DataFrame:
    """(doc_id, row, nth, source, size, source_size, target, copies) per row.

    ``row`` is the hash of (id, source, size), ``nth`` numbers the rows that
    share these and are interchangeable: together they deal the rows to leaves
    and order equal sizes.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"),
    ).withColumn("row", F.xxhash64("doc_id", "source", "size"))
    base = written(counted_rows(base), "mix-sizes")
    targets = written(source_targets(base, weights, max_repeats), "mix-targets")
    by_source = F.col("s.source").eqNullSafe(F.col("t.source"))
    # one row per source; Spark broadcasts it when its measured size allows
    rows = base.alias("s").join(targets.alias("t"), by_source).select("s.doc_id", "s.source", "s.size", "s.row", "s.nth", "t.n_docs", "t.source_size", "t.target")
    ratio = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(max_repeats)))
    rows = rows.withColumn("whole", F.floor(ratio)).withColumn("share", ratio - F.col("whole"))
    fractional = (F.col("size") > 0) & (F.col("share") > 0)
    sure = rows.filter(~fractional).withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)))

    leaves = F.ceil(F.col("n_docs") / F.lit(leaf_rows))
    work = rows.filter(fractional).withColumn("node", F.pmod(F.xxhash64(F.lit(seed), "row", "nth"), leaves))
    kept = ["doc_id", "source", "size", "row", "nth", "source_size", "target", "whole", "share", "node"]
    work = work.select(*kept)
    schema = work.withColumn("open", F.lit(True)).schema

    def rounding(level: int):
        return lambda pdf: _round_group(pdf, seed, level)[[*kept, "open"]]

    done = written(work.groupBy("source", "node").applyInPandas(rounding(0), schema), "mix-leaves")
    biggest = targets.agg(F.max(F.ceil(F.col("n_docs") / F.lit(leaf_rows)))).first()[0] or 0
    out = done.filter(~F.col("open"))
    residual = done.filter("open")
    depth = 1 + max(0, math.ceil(math.log(max(1, biggest), fan_in)))
    for level in range(1, depth + 1):
        up = residual.withColumn("node", F.floor(F.col("node") / F.lit(fan_in))).select(*kept)
        step = written(up.groupBy("source", "node").applyInPandas(rounding(level), schema), "mix-tree")
        out = out.unionByName(step.filter(~F.col("open")))
        residual = step.filter("open")
    # one row per source at most, rounded to the nearer side
    last = residual.withColumn("share", F.when(F.col("share") >= 0.5, 1.0).otherwise(0.0))
    rounded = out.unionByName(last).withColumn("copies", F.col("whole") + F.round("share").cast("bigint"))
    columns = ["doc_id", "row", "nth", "source", "size", "source_size", "target", F.col("copies").cast("bigint").alias("copies")]
    return sure.select(*columns).unionByName(rounded.select(*columns))


def taken(mixed: DataFrame) -> DataFrame:
    """The registered query's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
