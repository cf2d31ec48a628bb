"""Records laid out for reading by key: bucketed by it and sorted inside.

A reader that asks for one key opens one bucket's file, and a join by the key
of two such tables moves no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 32


def write_bucketed(df: DataFrame, path: str, table: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` under ``path`` in buckets of ``key``, one file each, sorted
    by ``key`` and ``order``, and register it as ``table``."""
    dealt = df.repartition(buckets, key)
    dealt.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, path: str, table: str, schema: str, key: str, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Register a table that ``write_bucketed`` wrote in another session."""
    by = ", ".join(f"`{c}`" for c in [key, *order])
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)
