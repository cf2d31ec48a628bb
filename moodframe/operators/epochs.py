"""Slot B's classifier: a linear model over the padded sequence of word numbers,
trained epoch by epoch.

In an epoch every task goes once over its training rows in small batches, from
the weights of the epoch before; the tasks' weights are averaged, weighted by
their rows.  After each epoch loss and accuracy are measured on the training
and the validation rows, and the epoch with the least validation loss is kept.
Padding takes no part; a sequence's evidence is divided by the root of its
length.

There are as many tasks as cores, so the weights that meet in an epoch grow with
the cluster and not with the data: one row a word number and task, summed by
word number, and at most ``num_words`` rows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.constants import MAX_SEQ_LEN, PAD_INDEX, VOCAB_NUM_WORDS

EPOCHS, BATCH = 10, 32
HISTORY = "epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double, is_best boolean"


@dataclass
class SequenceModel:
    """``weights``: a row a word number, the last one the bias; ``history``: a
    row an epoch."""

    weights: np.ndarray
    history: list[tuple] = field(default_factory=list)

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        return _softmax(_evidence(self.weights, ids))

    def curve(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, HISTORY)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, w.tolist()) for i, w in enumerate(self.weights)]
        spark.createDataFrame(rows, "number int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
        self.curve(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/history")


def load(spark: SparkSession, path: str) -> SequenceModel:
    rows = spark.read.parquet(f"{path}/weights").orderBy("number").collect()  # a row a word number
    history = spark.read.parquet(f"{path}/history").orderBy("epoch").collect()
    return SequenceModel(np.array([r["weights"] for r in rows]), [tuple(r) for r in history])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Padded sequences of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width), np.int32)


def _scale(ids: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum((ids != PAD_INDEX).sum(1), 1))


def _evidence(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    seen = np.where((ids == PAD_INDEX)[:, :, None], 0.0, weights[ids])
    return seen.sum(1) * _scale(ids)[:, None] + weights[-1]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pass_over(weights: np.ndarray, square: np.ndarray, ids: np.ndarray, label: np.ndarray, rate: float, ridge: float) -> None:
    """One pass in small batches, in place; ``square`` holds the squared slopes
    that the step sizes adapt to."""
    for lo in range(0, len(ids), BATCH):
        part, y = ids[lo : lo + BATCH], label[lo : lo + BATCH]
        slope = _softmax(_evidence(weights, part))
        slope[np.arange(len(y)), y] -= 1
        slope /= len(y)
        flat = part.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.diff(flat[order], prepend=-1))
        number = flat[order[first]]
        each = (slope * _scale(part)[:, None])[order // part.shape[1]]
        total = np.add.reduceat(each, first) if len(first) else np.zeros((0, weights.shape[1]))
        keep = number != PAD_INDEX
        rows = np.append(number[keep], len(weights) - 1)
        step = np.concatenate([total[keep], slope.sum(0, keepdims=True)]) + ridge * weights[rows]
        square[rows] += step**2
        weights[rows] -= rate * step / np.sqrt(square[rows])


def fit(
    train: DataFrame,
    validation: DataFrame,
    classes: int,
    ids_col: str = "ids",
    label_col: str = "label",
    num_words: int = VOCAB_NUM_WORDS,
    width: int = MAX_SEQ_LEN,
    epochs: int = EPOCHS,
    rate: float = 0.3,
    ridge: float = 1e-4,
) -> SequenceModel:
    """Train on written tables with padded ``ids`` of ``width`` and labels 0 …
    classes - 1.  Without validation rows the training loss decides."""
    spark = train.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    rows = train.select(F.col(ids_col).alias("ids"), F.col(label_col).cast("int").alias("label")).coalesce(tasks)
    told = rows.withColumn("held", F.lit(False)).unionByName(
        validation.select(F.col(ids_col).alias("ids"), F.col(label_col).cast("int").alias("label"), F.lit(True).alias("held"))
    )
    weights, square = np.zeros((num_words + 1, classes)), np.full((num_words + 1, classes), 1e-2)
    names = [f"c{i}" for i in range(2 * classes)]

    def epoch(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, squares, n = shared.value[0].copy(), shared.value[1].copy(), 0
            for b in batches:
                if b.num_rows:
                    pass_over(own, squares, _matrix(b.column("ids"), width), b.column("label").to_numpy(), rate, ridge)
                    n += b.num_rows
            if n:
                both = np.concatenate([own, squares], 1) * n
                moved = np.flatnonzero((own != shared.value[0]).any(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(moved, -1)), pa.array(np.full(len(moved) + 1, n)), *[pa.array(np.append(both[moved, i], 0.0)) for i in range(2 * classes)]],
                    names=["number", "n", *names],
                )

        return run

    def measure(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, 3))
            for b in batches:
                if b.num_rows:
                    p = _softmax(_evidence(shared.value[0], _matrix(b.column("ids"), width)))
                    y, held = b.column("label").to_numpy(), b.column("held").to_numpy(zero_copy_only=False).astype(int)
                    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))
                    for i, value in enumerate((np.ones(len(y)), loss, p.argmax(1) == y)):
                        sums[:, i] += np.bincount(held, value, 2)
            yield pa.RecordBatch.from_arrays([pa.array([False, True]), *[pa.array(sums[:, i]) for i in range(3)]], names=["held", "n", "loss", "hits"])

        return run

    history, best, kept = [], np.inf, weights
    for number in range(1, epochs + 1):
        shared = spark.sparkContext.broadcast((weights, square))
        sums = rows.mapInArrow(epoch(shared), "number long, n long, " + ", ".join(f"{c} double" for c in names))
        table = sums.groupBy("number").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()  # <= num_words + 2 rows
        at, n = table["number"].to_numpy(), table["n"].to_numpy()
        total = int(n[at < 0].sum())
        if not total:
            break
        moved = at >= 0
        at, values = at[moved], np.stack([table[c].to_numpy()[moved] for c in names], 1)
        # tasks that did not meet a word keep its weights
        rest = (total - n[moved])[:, None]
        old = np.concatenate([weights[at], square[at]], 1)
        mean = (values + old * rest) / total
        weights, square = weights.copy(), square.copy()
        weights[at], square[at] = mean[:, :classes], mean[:, classes:]
        shared = spark.sparkContext.broadcast((weights,))
        got = {r["held"]: r for r in told.mapInArrow(measure(shared), "held boolean, n double, loss double, hits double").groupBy("held").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("hits").alias("hits")).collect()}
        mean_of = lambda h, c: got[h][c] / got[h]["n"] if got[h]["n"] else None
        row = (number, mean_of(False, "loss"), mean_of(False, "hits"), mean_of(True, "loss"), mean_of(True, "hits"))
        judged = row[3] if row[3] is not None else row[1]
        if judged < best:
            best, kept, best_epoch = judged, weights, number
        history.append(row)
    return SequenceModel(kept, [(*row, row[0] == best_epoch) for row in history])


def probabilities(model: SequenceModel, df: DataFrame, key: str, ids_col: str = "ids", width: int = MAX_SEQ_LEN) -> DataFrame:
    """(key, probs) of padded sequences."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("array<double>")
    def probs(ids: pa.Array) -> pa.Array:
        p = _softmax(_evidence(shared.value, _matrix(ids, width)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return df.select(key, probs(ids_col).alias("probs"))
