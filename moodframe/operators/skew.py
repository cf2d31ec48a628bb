"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.operators.partitioning import materialised

#: A key with more than this share of the rows is heavy; there are fewer than
#: its reciprocal, and as many salts deal their rows out.
SHARE = 1 / 64


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list:
    """The values of ``key`` that hold more than ``share`` of the rows, from a
    count that is combined before its shuffle."""
    counts = materialised(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in counts.filter(F.col(key).isNotNull() & (F.col("n") > F.lit(total * share))).select(key).collect())  # < 1/share rows


def skewed_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: float = SHARE) -> DataFrame:
    """``left.join(right, key, how)`` for inner, left, left_semi and left_anti.

    Left rows of heavy keys are dealt out by a salt, and the right rows of
    those few keys are repeated for each salt; all other rows meet in the
    ordinary join.  ``left`` is read three times: pass a written table.
    """
    heavy = heavy_keys(left.select(key), key, share)
    if not heavy:
        return left.join(right, key, how)
    salts = int(1 / share)
    own = F.col(key).isin(heavy)
    dealt = left.filter(own).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    repeated = right.filter(own).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = dealt.join(repeated, [key, "_salt"], how).drop("_salt")
    rest = left.filter(F.coalesce(~own, F.lit(True))).join(right.filter(~own), key, how)
    return rest.unionByName(met)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` in ``left`` that ``right`` lacks.  A key
    is one row before the shuffle, however many rows hold it."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")
