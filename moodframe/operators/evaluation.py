"""Classification evaluation over (actual, predicted) label ids.

The only wide step is one aggregation by (actual, predicted), combined
map-side.  That count table is written once and everything is derived from it.
Rows without an actual label are no evidence and are left out; a prediction
that is missing or outside the labels is a wrong one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.functions.constants import EMOTIONS
from moodframe.operators.partitioning import materialised


def pair_counts(pairs: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) of all pairs with an actual label, written once."""
    counts = (
        pairs.filter(F.col(actual).isNotNull())
        .groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return materialised(counts, "pair-counts")


def confusion_grid(counts: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    """Dense k x k matrix in long form (actual, predicted, n), zeros included.
    Pairs outside the labels have no cell in it (they count in the metrics)."""
    k = len(labels)
    grid = counts.sparkSession.range(k * k).select(
        (F.col("id") / k).cast("int").alias("actual"), (F.col("id") % k).cast("int").alias("predicted")
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_long(pairs: DataFrame, labels: list[str] = EMOTIONS, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return confusion_grid(pair_counts(pairs, actual, predicted), labels)


def confusion_wide(pairs: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    long = confusion_long(pairs, labels)
    return long.groupBy("actual").pivot("predicted", list(range(len(labels)))).agg(F.first("n")).select(
        "actual", *[F.col(str(i)).alias(f"pred_{i}") for i in range(len(labels))]
    )


def label_stats(counts: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    """(label_id, precision, recall, f1, support, tp) of every label that is
    named or occurs; 0 where undefined.  Each count adds to its actual label's
    support, its predicted label's total and, on the diagonal, the hits."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    parts = F.array(
        F.struct(F.col("actual").alias("label_id"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted_n")),
        F.struct(F.col("predicted").alias("label_id"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted_n")),
    )
    named = counts.sparkSession.range(len(labels)).select(
        F.col("id").cast("int").alias("label_id"), zero.alias("tp"), zero.alias("support"), zero.alias("predicted_n")
    )
    each = counts.select(F.inline(parts)).filter(F.col("label_id").isNotNull()).unionByName(named)
    j = each.groupBy("label_id").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted_n")])
    prec = F.when(F.col("predicted_n") > 0, F.col("tp") / F.col("predicted_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = j.select("label_id", "tp", prec.alias("precision"), rec.alias("recall"), F.col("support").cast("bigint").alias("support"))
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def _named(stats: DataFrame, labels: list[str]) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(e) for e in labels]), F.col("label_id") + 1)
    return stats.filter(F.col("label_id").between(0, len(labels) - 1)).select(
        "label_id", names.alias("emotion"), "precision", "recall", "f1", "support"
    )


def _weighted(c: str):
    return F.sum(F.col(c) * F.col("support")) / F.sum("support")


def classification_report(pairs: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    """Per-class rows plus 'accuracy', 'macro avg' (over the named labels) and
    'weighted avg' (over all rows)."""
    stats = materialised(label_stats(pair_counts(pairs), labels), "label-stats")  # a row per label
    inside = F.col("label_id").between(0, len(labels) - 1)
    mean = lambda c: F.avg(F.when(inside, F.col(c)))
    none = F.lit(None).cast("double")
    row = lambda i, name, p, r, f: F.struct(
        F.lit(i).alias("label_id"), F.lit(name).alias("emotion"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("support").alias("support")
    )
    tot = stats.agg(
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[mean(c).alias(f"mean_{c}") for c in ("precision", "recall", "f1")],
        *[_weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
    )
    averages = F.array(
        row(-3, "accuracy", none, none, F.col("accuracy")),
        row(-2, "macro avg", *[F.col(f"mean_{c}") for c in ("precision", "recall", "f1")]),
        row(-1, "weighted avg", *[F.col(f"weighted_{c}") for c in ("precision", "recall", "f1")]),
    )
    return _named(stats, labels).unionByName(tot.select(F.inline(averages)))


def weighted_metrics(pairs: DataFrame, labels: list[str] = EMOTIONS) -> DataFrame:
    """One row: accuracy, weighted precision / recall / F1 over every row
    (0 where undefined), whatever labels occur."""
    return label_stats(pair_counts(pairs), labels).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), *[_weighted(c).alias(c) for c in ("precision", "recall", "f1")]
    )


def mllib_weighted_metrics(pairs: DataFrame) -> dict[str, float]:
    """Cross-check with MLlib's evaluator (weightedPrecision / weightedRecall / f1 / accuracy)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    d = pairs.select(F.col("actual").cast("double").alias("label"), F.col("predicted").cast("double").alias("prediction"))
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction")
    return {m: ev.setMetricName(m).evaluate(d) for m in ["accuracy", "weightedPrecision", "weightedRecall", "f1"]}


def write_evaluation(pairs: DataFrame, path: str, labels: list[str] = EMOTIONS) -> None:
    """Metrics (one JSON row) under ``metrics`` and the report (a JSON row per
    label or average) under ``report``."""
    weighted_metrics(pairs, labels).coalesce(1).write.mode("overwrite").json(f"{path}/metrics")
    classification_report(pairs, labels).orderBy("label_id").coalesce(1).write.mode("overwrite").json(f"{path}/report")
