"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters, digits and apostrophes.  The field has two states,
toxic and not; a token's evidence is the sum of weights of its features (word,
beginnings of the word, both neighbours, shape).  Forward and backward messages
give each token's marginal probability; those of a text are joined as the
chance that any token is toxic, which a logistic curve fitted on held-back
training rows turns into the document's score.  Spans are runs of tokens whose
marginal is one half or more.

Labels are of documents, so training tokens are labelled through them: over all
training rows, documents are counted by label for each word and word beginning,
and a token of a toxic document is labelled toxic if one of its own has log-odds
of at least ``least_odds`` towards toxic, ``least_z`` standard errors off zero.

Bounds (documented parameters): ``fit_rows`` training rows, half of either label
where there are enough, chosen by the hash of their id and text, give a window
of ``window`` tokens each to the field (of a toxic text around a labelled token);
a fifth as many others fit the curve, on whole texts; ``max_seeds`` words and
beginnings are collected; 2**WIDTH weights are fitted.  The counts take in every
training row and every row is scored on its whole text.  Texts of over a
``SEGMENT`` of tokens go through the messages in segments that overlap by
``OVERLAP`` tokens, far beyond which a message of two states is forgotten.

Defined results: null, empty and wordless texts get the score of no evidence and
no spans; training rows with null text count as empty, with null or other labels
or null id they are left out, repeated ones count as often as they occur; without
training rows of both labels, or without a word that tells them apart, every
score is the share of label 1 (0 without any); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import with_columns
from moodframe.llm.words import hashes, mix, owners, slices, utf8

WIDTH = 20
BEGINNINGS = (4, 5, 6, 7)
SEGMENT, OVERLAP = 1 << 17, 512
#: Different words and beginnings that a task holds while it counts.
HELD = 1 << 20

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 39]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def token_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each token; a text's end also ends a token."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = _INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    some = offsets[:-1] < offsets[1:]
    begins[offsets[:-1][some]] = inside[offsets[:-1][some]]
    ends[offsets[1:][some] - 1] = inside[offsets[1:][some] - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Tokens:
    """Tokens of a string column, with the keys of their words and beginnings
    (0 where a word is not longer than the beginning)."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        self.starts, self.ends = token_bounds(self.data, self.offsets)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.text = owners(self.starts, self.offsets)
        self.word = hashes(self.data, self.starts, self.ends)
        keys = [mix(self.word.copy(), 40)]
        for n in BEGINNINGS:
            longer = self.ends - self.starts > n
            own = np.zeros(len(self.starts), np.uint64)
            own[longer] = mix(hashes(self.data, self.starts[longer], self.starts[longer] + n), 40 + n)
            keys.append(own)
        self.keys = keys

    def features(self, lo: int, hi: int) -> np.ndarray:
        """Feature numbers of tokens lo to hi, one row each; the last feature
        stands for none."""
        none = np.uint32(1 << WIDTH)
        slot = lambda k: (k >> np.uint64(64 - WIDTH)).astype(np.uint32)
        out = np.full((hi - lo, len(self.keys) + 3), none, np.uint32)
        for i, key in enumerate(self.keys):
            out[:, i] = np.where(key[lo:hi] == 0, none, slot(key[lo:hi]))
        at = np.arange(lo, hi)
        before, after = np.maximum(at - 1, 0), np.minimum(at + 1, len(self.word) - 1)
        for i, (beside, salt) in enumerate(((before, 51), (after, 52))):
            same = (beside != at) & (self.text[beside] == self.text[at])
            out[:, len(self.keys) + i] = np.where(same, slot(mix(self.word[beside], salt)), none)
        shape = _UPPER[self.data[self.starts[lo:hi]]].astype(np.uint64) + 2 * _UPPER[self.data[self.ends[lo:hi] - 1]] + 4 * np.minimum(self.ends[lo:hi] - self.starts[lo:hi], 12).astype(np.uint64)
        out[:, -1] = slot(mix(shape.astype(np.uint64), 53))
        return out


def _product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    c = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    most = np.maximum(np.maximum(c[0], c[1]), np.maximum(c[2], c[3]))
    return [x / most for x in c]


def messages(evidence: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward (a0, a1) and backward (b0, b1) messages, each up to a factor, of
    sequences laid end to end (``first`` marks their beginnings).

    A step is a 2 x 2 matrix; one that begins a sequence has equal rows and
    forgets what precedes it.  Products run inside blocks of about the square
    root of all steps, all blocks at once, and are then chained.
    """
    n = len(evidence)
    side = max(1, int(np.ceil(np.sqrt(n))))
    blocks = -(-n // side)
    x = np.exp(np.clip(evidence, -30, 30))
    to_toxic, to_plain, stay, begin = np.exp(chain)
    one = np.ones(n)
    steps = [one.copy(), np.where(first, begin * x, to_toxic * x), np.where(first, one, to_plain), np.where(first, begin * x, stay * x)]
    most = np.maximum(np.maximum(steps[0], steps[1]), np.maximum(steps[2], steps[3]))
    grid = []
    for value, idle in zip(steps, (1.0, 0.0, 0.0, 1.0)):
        padded = np.full(blocks * side, idle)
        padded[:n] = value / most
        grid.append(np.ascontiguousarray(padded.reshape(blocks, side).T))
    ahead = [np.empty_like(g) for g in grid]
    behind = [np.empty_like(g) for g in grid]
    now = [g[0] for g in grid]
    for k in range(side):
        now = [g[0] for g in grid] if k == 0 else _product(now, [g[k] for g in grid])
        for kept, value in zip(ahead, now):
            kept[k] = value
    full = now
    now = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for k in range(side - 1, -1, -1):
        for kept, value in zip(behind, now):
            kept[k] = value
        now = _product([g[k] for g in grid], now)
    into, out = np.empty((2, blocks)), np.empty((2, blocks))
    total = np.stack(full).reshape(2, 2, blocks)
    vector = np.array([1.0, 0.0])
    for k in range(blocks):
        into[:, k] = vector
        vector = vector @ total[:, :, k]
        vector = vector / vector.max()
    vector = np.ones(2)
    for k in range(blocks - 1, -1, -1):
        out[:, k] = vector
        vector = total[:, :, k] @ vector
        vector = vector / vector.max()
    flat = lambda g: g.T.reshape(-1)[:n]
    a0, a1 = (flat(into[0] * ahead[j] + into[1] * ahead[2 + j]) for j in (0, 1))
    b0, b1 = (flat(behind[2 * i] * out[0] + behind[2 * i + 1] * out[1]) for i in (0, 1))
    return a0, a1, b0, b1


def marginals(evidence: np.ndarray, first: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Probability of toxic for each token."""
    if not len(evidence):
        return np.zeros(0)
    a0, a1, b0, b1 = messages(evidence, first, chain)
    return a1 * b1 / (a0 * b0 + a1 * b1)


@dataclass
class Model:
    """``weights`` by feature (the last one is none), ``chain``: potentials of
    plain to toxic, toxic to plain, toxic to toxic and of beginning toxic;
    ``curve``: slope on evidence, slope on length, shift."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << WIDTH) + 1, np.float32))
    chain: np.ndarray = field(default_factory=lambda: np.zeros(4))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def tag(self, tokens: Tokens) -> np.ndarray:
        """Marginal of each token."""
        n = len(tokens.starts)
        first = np.zeros(n, bool)
        first[tokens.bounds[:-1][tokens.bounds[:-1] < tokens.bounds[1:]]] = True
        out = np.empty(n)
        for lo in range(0, n, SEGMENT):
            hi = min(lo + SEGMENT, n)
            begin, end = max(lo - OVERLAP, 0), min(hi + OVERLAP, n)
            opening = first[begin:end].copy()
            opening[0] = True
            evidence = self.weights[tokens.features(begin, end)].sum(1, dtype=np.float64)
            out[lo:hi] = marginals(evidence, opening, self.chain)[lo - begin : hi - begin]
        return out

    def evidence(self, tokens: Tokens, p: np.ndarray) -> np.ndarray:
        """(log-odds that any token is toxic, log length, 1) for each text."""
        missed = np.concatenate([[0.0], np.cumsum(-np.log1p(-np.minimum(p, 1 - 1e-12)))])
        total = np.clip(missed[tokens.bounds[1:]] - missed[tokens.bounds[:-1]], 1e-9, 30.0)
        length = np.log1p(np.diff(tokens.bounds))
        return np.stack([np.log(np.expm1(total)), length, np.ones(len(total))], 1)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ self.curve, -30, 30)))


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return float(np.log(share / (1 - share)))


def _rows(train: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    rows = train.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    return rows.filter("id is not null and label in (0, 1)")


def seeds(rows: DataFrame, docs: tuple[int, int], least_odds: float, least_z: float, max_seeds: int) -> np.ndarray:
    """Keys of words and beginnings that tell toxic documents apart, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []
        held = 0

        def added() -> pa.RecordBatch:
            both = np.concatenate(fresh) if fresh else np.zeros((2, 0), np.uint64).T
            order = np.argsort(both[:, 0], kind="stable")
            key, toxic = both[order, 0], both[order, 1].astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(key)))
            bad = np.add.reduceat(toxic, at) if len(at) else n
            return pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(bad), pa.array(n - bad)], names=["key", "toxic", "plain"])

        for batch in batches:
            for b in slices(batch, "text"):
                tokens = Tokens(b.column("text"))
                label = b.column("label").to_numpy().astype(np.uint64)
                for key in tokens.keys:
                    some = np.flatnonzero(key)
                    text = tokens.text[some]
                    order = np.lexsort((key[some], text))
                    text, own = text[order], key[some][order]
                    one = np.ones(len(own), bool)
                    one[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
                    fresh.append(np.stack([own[one], label[text[one]]], 1))
                    held += int(one.sum())
                if held > HELD:
                    yield added()
                    fresh, held = [], 0
        yield added()

    counts = rows.select("text", "label").mapInArrow(count, "key long, toxic long, plain long")
    table = counts.groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("plain").alias("b"))
    of = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(float(n)) - F.col(c) + 0.5))
    odds = of("a", docs[1]) - of("b", docs[0])
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    told = table.filter("a >= 4").select("key", odds.alias("odds"), (odds / error).alias("z")).filter(F.col("odds") >= least_odds).filter(F.col("z") >= least_z)
    best = told.orderBy(F.desc("z"), "key").limit(max_seeds).select("key").toArrow()
    return np.sort(best["key"].to_numpy().view(np.uint64))


def labelled(tokens: Tokens, toxic: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each token lies in a toxic text and has a seed."""
    found = np.zeros(len(tokens.starts), bool)
    if len(known):
        for key in tokens.keys:
            place = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found |= (known[place] == key) & (key != 0)
    return found & toxic[tokens.text]


def train_field(features: np.ndarray, tag: np.ndarray, first: np.ndarray, rounds: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and chain that maximise the likelihood of the tags, by full
    gradients with step sizes adapted to each parameter."""
    seen_at = np.zeros((1 << WIDTH) + 1, bool)
    seen_at[features] = True
    used = np.flatnonzero(seen_at)
    place = np.zeros(len(seen_at), np.int32)
    place[used] = np.arange(len(used))
    # one feature of all tokens at a time, so that no array is larger than they
    columns = [place[c] for c in features.T]
    w, chain = np.zeros(len(used)), np.array([-3.0, 0.0, -3.0, -3.0])
    live = used != (1 << WIDTH)
    square_w, square_c = np.full(len(used), 1e-8), np.full(4, 1e-8)
    y = tag.astype(float)
    inner = ~first
    inner[0] = False
    at = np.flatnonzero(inner)
    for _ in range(rounds):
        evidence = np.zeros(len(y))
        for c in columns:
            evidence += w[c]
        a0, a1, b0, b1 = messages(evidence, first, chain)
        p = a1 * b1 / (a0 * b0 + a1 * b1)
        slope = -ridge * w
        for c in columns:
            slope += np.bincount(c, y - p, len(used))
        slope[~live] = 0
        x = np.exp(np.clip(evidence[at], -30, 30))
        move = np.exp(chain)
        pair = np.stack([a0[at - 1] * b0[at], a0[at - 1] * move[0] * x * b1[at], a1[at - 1] * move[1] * b0[at], a1[at - 1] * move[2] * x * b1[at]])
        pair /= pair.sum(0)
        seen = [((1 - y[at - 1]) * y[at]).sum(), (y[at - 1] * (1 - y[at])).sum(), (y[at - 1] * y[at]).sum(), y[first].sum()]
        slope_c = np.array(seen) - np.append(pair[1:].sum(1), p[first].sum()) - 0.1 * chain
        square_w += slope**2
        square_c += slope_c**2
        w += rate * slope / np.sqrt(square_w)
        chain = chain + rate * slope_c / np.sqrt(square_c)
    weights = np.zeros((1 << WIDTH) + 1, np.float32)
    weights[used] = w
    return weights, chain


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic curve by Newton steps; the slope on evidence is not negative."""
    b = np.array([1.0, 0.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3)
        b += np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * (b - [0.3, 0, 0])), -3, 3)
    b[0] = max(b[0], 0.0)
    return b


def fit(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    fit_rows: int = 4000,
    window: int = 256,
    least_odds: float = 2.0,
    least_z: float = 3.0,
    max_seeds: int = 1 << 16,
    rounds: int = 40,
    rate: float = 0.5,
    ridge: float = 0.01,
    seed: int = 12,
) -> Model:
    """Fit on (id, text, label in 0/1) rows."""
    rows = _rows(train, id_col, text_col, label_col)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    docs = n.get(0, 0), n.get(1, 0)
    constant = Model(curve=np.array([0.0, 0.0, _log_odds(docs[1] / sum(docs) if sum(docs) else 0.0)]))
    if not all(docs):
        return constant
    known = seeds(rows, docs, least_odds, least_z, max_seeds)
    if not len(known):
        return constant

    # a sample of either label; its first fifth fits the curve
    rank = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text")
    share = (F.pmod(rank, F.lit(1 << 30)) / float(1 << 30)).alias("part")
    half = max(1, fit_rows * 5 // 8)
    part = F.when(F.col("label") == 1, F.lit(min(1.0, half / docs[1]))).otherwise(F.lit(min(1.0, half / docs[0])))
    drawn = rows.withColumn("part", share).filter(F.col("part") <= part * 1.25)
    drawn = drawn.withColumn("curve", F.col("part") < part / 5)
    few = drawn.filter("label = 1").orderBy("part", "id", "text").limit(half).unionByName(drawn.filter("label = 0").orderBy("part", "id", "text").limit(half))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                tokens = Tokens(b.column("text"))
                label = b.column("label").to_numpy() == 1
                tag = labelled(tokens, label, known)
                out: list[tuple[bytes, bytes]] = []
                for i, (lo, hi) in enumerate(zip(tokens.bounds[:-1].tolist(), tokens.bounds[1:].tolist())):
                    own = np.flatnonzero(tag[lo:hi])
                    draw = int(mix(np.array([hi - lo + i], np.uint64), seed)[0] >> np.uint64(1))
                    middle = lo + int(own[draw % len(own)]) if len(own) else lo + draw % max(hi - lo, 1)
                    begin = max(lo, min(middle - window // 2, hi - window))
                    end = min(hi, begin + window)
                    out.append((tokens.features(begin, end).tobytes() if end > begin else b"", tag[begin:end].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], names=["features", "tags"])

    sample = few.filter("not curve").select("text", "label").mapInArrow(cut, "features binary, tags binary").collect()  # <= fit_rows windows
    sample = sorted((bytes(r["tags"]), bytes(r["features"])) for r in sample if r["tags"])
    if not sample:
        return constant
    features = np.concatenate([np.frombuffer(f, np.uint32) for _, f in sample]).reshape(-1, len(BEGINNINGS) + 4)
    tag = np.concatenate([np.frombuffer(t, bool) for t, _ in sample])
    first = np.zeros(len(tag), bool)
    first[np.cumsum([0, *[len(t) for t, _ in sample[:-1]]])] = True
    model = Model(*train_field(features, tag, first, rounds, rate, ridge))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                tokens = Tokens(b.column("text"))
                x = shared.value.evidence(tokens, shared.value.tag(tokens))
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["label", "odds", "length"])

    told = few.filter("curve").select("text", "label").mapInArrow(weigh, "label int, odds double, length double").toArrow()  # <= fit_rows / 4 rows
    y = told["label"].to_numpy().astype(float)
    if not (y == 0).any() or not (y == 1).any():
        return constant
    x = np.stack([told["odds"].to_numpy(), told["length"].to_numpy(), np.ones(len(y))], 1)
    natural = np.where(y == 1, docs[1] / (y == 1).sum(), docs[0] / (y == 0).sum())
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    model.curve = fit_curve(x[order], y[order], (natural * len(y) / sum(docs))[order])
    return model


def _spans(tokens: Tokens, p: np.ndarray, least: float) -> list[str]:
    """Runs of tokens at or above ``least`` as ``start:end`` in code points."""
    out = [""] * (len(tokens.bounds) - 1)
    hot = np.flatnonzero(p >= least)
    if not len(hot):
        return out
    chars = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
    new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(tokens.text[hot]) > 0)])
    lo, hi = hot[new], hot[np.append(np.flatnonzero(new)[1:] - 1, len(hot) - 1)]
    text = tokens.text[lo]
    base = chars[tokens.offsets[text]]
    for i, a, b in zip(text.tolist(), (chars[tokens.starts[lo]] - base).tolist(), (chars[tokens.ends[hi]] - base).tolist()):
        out[i] += f",{a}:{b}" if out[i] else f"{a}:{b}"
    return out


def score(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    keep: list[str] | None = None,
    threshold: float = 0.5,
    names: tuple[str, str, str] = ("score", "predicted", "spans"),
) -> DataFrame:
    """``keep`` columns of ``docs`` plus score, predicted and the offending
    spans (code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for b in slices(batch, at):
            tokens = Tokens(b.column(at))
            p = shared.value.tag(tokens)
            got = shared.value.scores(shared.value.evidence(tokens, p))
            yield b, [pa.array(got), pa.array((got >= threshold).astype(np.int32)), pa.array(_spans(tokens, p, 0.5), pa.string())]

    return with_columns(docs, text_col, docs.columns if keep is None else keep, dict(zip(names, ("double", "int", "string"))), each)
