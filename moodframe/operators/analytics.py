"""Session analytics over history rows: counts, KPIs, series, recent items.

Every aggregate here is keyed by a handful of labels, so Spark combines
partially on the map side and shuffles only a few rows per partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def emotion_counts(history: DataFrame) -> DataFrame:
    """Interactions per (mixed) emotion label, most frequent first."""
    return (
        history.groupBy("emotion")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("emotion"))
    )


def field_emotion_model_counts(history: DataFrame) -> DataFrame:
    return (
        history.groupBy("field", "emotion", "model")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("field", "emotion", "model")
    )


def history_kpis(history: DataFrame) -> DataFrame:
    """interactions, mean confidence, most common emotion (lowest label on ties).

    One global aggregation: ``mode`` keeps a per-partition count map over the
    distinct labels (a few hundred at most) and merges those maps, so no group
    is gathered in one place.
    """
    return history.agg(
        F.count(F.lit(1)).alias("interactions"),
        F.avg("confidence").alias("avg_confidence"),
        F.mode("emotion", deterministic=True).alias("most_common_emotion"),
    )


def confidence_series(history: DataFrame) -> DataFrame:
    """Confidence in interaction order, with the HH:mm:ss time label."""
    ordered = history.select("ts", "seq", "slot", F.date_format("ts", "HH:mm:ss").alias("time"), "confidence")
    return ordered.orderBy("ts", "seq", "slot").drop("ts")


def recent_sessions(history: DataFrame, n: int = 3) -> DataFrame:
    """Latest n interactions, newest first (a top-k: TakeOrderedAndProject)."""
    return history.orderBy(F.col("ts").desc(), F.col("seq").desc(), F.col("slot").desc()).limit(n).select(
        "seq", "slot", "field", "emotion", "confidence"
    )


def history_summary(history: DataFrame) -> DataFrame:
    return history.select("seq", "slot", "ts", "field", "emotion", "confidence", "model", "response_type")
