"""Dense, ordered row numbers without a single-partition window.

``row_number() over (order by …)`` with no partition moves every row into one
task.  Instead rows are range-partitioned by the order columns, sorted and
written with their partition and position; per-partition counts (one row per
partition) become offsets that are added to the positions.  Narrow rows are
moved as they are and not joined; of wide ones the order columns alone are
moved, and the numbers are joined back by them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.operators.partitioning import materialised


def with_row_numbers(df: DataFrame, order_cols: list[str], name: str = "row_index", start: int = 1) -> DataFrame:
    """``df`` (narrow rows) plus ``name``: start, start + 1, … in the order of
    ``order_cols`` (nulls first, as Spark sorts; equal rows in any order).
    ``df`` is read twice, once to choose the ranges: pass a written table."""
    ordered = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    # the position is the low part of the id
    tagged = materialised(
        ordered.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth")), "dense-index"
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a global window here is over a few hundred rows.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", (F.coalesce(F.sum("_n").over(w), F.lit(0)) + F.lit(start)).alias("_off"))
    numbered = tagged.join(F.broadcast(offsets), "_pid")
    return numbered.select(*df.columns, (F.col("_off") + F.col("_nth")).cast("bigint").alias(name))


def with_dense_index(df: DataFrame, order_cols: list[str], name: str = "row_index", start: int = 1) -> DataFrame:
    """As ``with_row_numbers`` for wide rows, which ``order_cols`` together
    identify.  Of a written table only these columns are read to be numbered."""
    numbers = with_row_numbers(df.select(*order_cols), order_cols, name, start)
    renamed = numbers.select(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)], name)
    same = F.lit(True)
    for i, c in enumerate(order_cols):
        same = same & df[c].eqNullSafe(renamed[f"_o{i}"])
    return df.join(renamed, same).select(*[df[c] for c in df.columns], name)
