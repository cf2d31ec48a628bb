"""Quality classifier: support vectors on Naive Bayes log-count ratios.

Features are indicators of hashed n-grams: runs of one and two lower-cased
words, and of one to three word shapes (capitals, digits, closing sign, repetition of the word
before).  Their document counts by label over all training rows give log-count
ratios; a linear hinge-loss model on the scaled, length-normalised indicators
is fitted by dual coordinate descent.  Platt scaling on sampled rows that the
descent does not see turns margins into probabilities.

Bounds (documented parameters): ``fit_rows`` training rows, chosen by the hash
of their id, enter the descent and the scaling; counts take in every training
row.  Features are hashed to a width that follows the bytes of the training
texts, of at least 2**LEAST_WIDTH and at most 2**MOST_WIDTH numbers, which are
collected.  Every row is scored on its whole
text.

Defined results: null, empty or blank text has no features and gets the score
of the bias; training rows with null label or id are left out, repeated ones
count as often as they occur; without training rows of both labels every score
is the share of label 1 (0.5 without any); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import with_columns
from moodframe.llm.words import hashes, mix, slices, utf8, word_bounds

LEAST_WIDTH, MOST_WIDTH = 17, 21
#: Bytes of training text for a feature number.
BYTES_A_NUMBER = 16
#: At most so many label rows (12 bytes each) are broadcast to the texts.
BROADCAST_LABELS = 2_000_000

_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_SIGN = np.arange(256, dtype=np.uint64)
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 0


def width_for(size: int) -> int:
    """Bits of a feature number for training texts of ``size`` bytes."""
    return min(MOST_WIDTH, max(LEAST_WIDTH, int(size // BYTES_A_NUMBER).bit_length()))


def features(column: pa.Array, width: int = MOST_WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of ``width`` bits, offsets per text), distinct and
    sorted in each text."""
    data, offsets = utf8(column)
    starts, ends = word_bounds(data, offsets)
    at = np.searchsorted(starts, offsets)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    text = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(at))
    word = hashes(data, starts, ends)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data], dtype=np.int64)])
    digit = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    length = ends - starts
    capitals = upper[ends] - upper[starts]
    same = np.zeros(n, bool)
    same[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = _SIGN[data[ends - 1]]
    for bit, mark in enumerate((_UPPER[data[starts]] > 0, (capitals > 1) & (2 * capitals >= length), digit[ends] > digit[starts], same, length == 1)):
        shape = shape | (mark.astype(np.uint64) << np.uint64(8 + bit))
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        pair = mix(word[:-1] * odd + word[1:], 30)
        one = mix(shape, 32)
        two = mix(one[:-1] * odd + one[1:], 33)
        three = mix(two[:-1] * odd + one[2:], 34)
    inside = [text[k:] == text[: n - k] for k in (1, 2)]
    grams = [(text, mix(word, 31)), (text[1:][inside[0]], pair[inside[0]]), (text, one), (text[1:][inside[0]], two[inside[0]]), (text[2:][inside[1]], three[inside[1]])]
    packed = np.concatenate([(owner << np.uint64(width)) | (key >> np.uint64(64 - width)) for owner, key in grams])
    packed = np.unique(packed)
    bounds = np.searchsorted(packed, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(width))
    return (packed & np.uint64((1 << width) - 1)).astype(np.uint32), bounds


@dataclass
class Model:
    weights: np.ndarray  # per feature, log-count ratio included
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    @property
    def width(self) -> int:
        return len(self.ratio).bit_length() - 1

    def score(self, column: pa.Array) -> np.ndarray:
        found, at = features(column, self.width)
        dot = np.concatenate([[0.0], np.cumsum(self.weights[found], dtype=np.float64)])
        norm = np.concatenate([[0.0], np.cumsum(self.ratio[found].astype(np.float64) ** 2)])
        size = np.sqrt(np.maximum(norm[at[1:]] - norm[at[:-1]], 1e-12))
        margin = (dot[at[1:]] - dot[at[:-1]]) / size + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias feature of 1."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    values = []
    for r in rows:
        v = ratio[r].astype(float)
        values.append(v / max(np.sqrt((v * v).sum()), 1e-6))
    q = np.array([(v * v).sum() + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / q[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve by Newton steps on smoothed targets."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-4 * b)
        b += np.clip(step, -5, 5)
    return float(b[0]), float(b[1])


def fit(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    fit_rows: int = 6000,
    epochs: int = 12,
    cost: float = 1.0,
    alpha: float = 1.0,
    seed: int = 3,
) -> Model:
    """Fit on (id, text, label in 0/1) rows."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter("id is not null and label in (0, 1)")

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = width_for(size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << width), np.int64)
        docs = np.zeros(2, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                found, at = features(b.column("text"), width)
                label = b.column("label").to_numpy()
                owner = np.repeat(label, np.diff(at))
                for y in (0, 1):
                    total[y] += np.bincount(found[owner == y], minlength=1 << width)
                docs += np.bincount(label, minlength=2)
        seen = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1)), pa.array(np.append(total[0, seen], docs[0])), pa.array(np.append(total[1, seen], docs[1]))],
            names=["feature", "bad", "good"],
        )

    counts = rows.select("text", "label").mapInArrow(count, "feature long, bad long, good long")
    table = counts.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # <= 2**MOST_WIDTH + 1 rows
    feature = table["feature"].to_numpy()
    by_label = np.zeros((2, 1 << width))
    keep = feature >= 0
    by_label[0, feature[keep]] = table["bad"].to_numpy()[keep]
    by_label[1, feature[keep]] = table["good"].to_numpy()[keep]
    docs = [int(table[c].to_numpy()[~keep].sum()) for c in ("bad", "good")]
    share = docs[1] / sum(docs) if sum(docs) else 0.5
    p = (by_label + alpha) / (np.array(docs)[:, None] + 2 * alpha)
    ratio = np.log(p[1] / p[0]).astype(np.float32)
    ratio[~by_label.any(0)] = 0.0
    constant = Model(np.zeros(1 << width, np.float32), ratio, 0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if not all(docs):
        return constant

    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.filter(part <= F.lit(3.0 * fit_rows / sum(docs))).orderBy(F.xxhash64(F.lit(seed), "id"), "id", "text").limit(fit_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                found, at = features(b.column("text"), width)
                each = [found[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(each, pa.binary())], names=["label", "features"])

    sample = few.select("text", "label").mapInArrow(encode, "label int, features binary").collect()
    y = np.array([2 * r["label"] - 1 for r in sample])
    x = [np.frombuffer(r["features"], np.uint32) for r in sample]
    hold = np.arange(len(x)) % 5 == 0
    if not all((y[m] == v).any() for m in (hold, ~hold) for v in (-1, 1)):
        return constant
    fitted = [r for r, h in zip(x, hold) if not h]
    labels = y[~hold]
    weight = np.where(labels > 0, len(labels) / (2 * (labels > 0).sum()), len(labels) / (2 * (labels < 0).sum()))
    w, bias = descend(fitted, labels, ratio, cost * weight, epochs, seed)
    model = Model((w * ratio).astype(np.float32), ratio, bias, 1.0, 0.0)
    margin = np.array([model.weights[r].sum(dtype=float) / np.sqrt(max((ratio[r].astype(float) ** 2).sum(), 1e-12)) + bias for r in x])
    model.slope, model.shift = platt(margin[hold], y[hold])
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns of ``docs`` plus score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for b in slices(batch, at):
            got = shared.value.score(b.column(at))
            yield b, [pa.array(got), pa.array((got >= threshold).astype(np.int32))]

    return with_columns(docs, text_col, docs.columns if keep is None else keep, dict(zip(names, ("double", "int"))), each)


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of the labelled documents.  The labels are broadcast
    while their count allows, else both sides are shuffled."""
    few = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    if few.count() <= BROADCAST_LABELS:
        few = F.broadcast(few)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few, "id")
