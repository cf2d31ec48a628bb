"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.session import scratch_path


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan of few files over the cluster.

    Text lengths are very uneven, and one parquet row group is one task.  Only
    the file list of the plan is looked at; nothing runs.  A large input made
    of many files is already split finely, so no shuffle is added there.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    return df.repartition(target) if 0 < len(files) < target else df


def fenced(expr: Column) -> Column:
    """``expr`` as a value that filters above it cannot be pushed through.

    A filter on a column derived from an expensive expression is otherwise
    pushed through the projections (and through a repartition) to the scan,
    where the whole expression is evaluated a second time; an expression read
    several times is copied.  Catalyst does neither with a nondeterministic
    value, and ``spark_partition_id() >= 0`` is the cheapest one that is always
    true.  It sits inside the value, so column pruning cannot remove it.
    """
    return F.when(F.spark_partition_id() >= 0, expr)


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: what follows reads the result
    as often as it likes, and lineage is cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
