"""Language-model scoring with a small causal self-attention model in numpy.

Base: an add-0.1 word model over exact counts of all training words.
Model: ids of a public byte-pair file (words lower-cased, each beginning with a
space; one end id a text) are read in windows of ``WINDOW`` ids of which all
but the first ``OVERLAP`` are scored, so every id is scored once with at least
``OVERLAP`` ids before it (where the text has them).  One masked attention layer
over id and position vectors and a hidden layer predict a class of the next id;
within a class the share of an id comes from counts over all training texts.
The most frequent ids are classes of their own; the others are dealt, by
frequency and by whether they begin a word, to shared classes.

Distribution: one pass turns each text into ids, which are written; counting,
both training rounds and scoring read them.  A word's key is a hash of its ids.
Words and ids are counted per task and summed in a shuffle.  The layers start
from a bounded sample (``fit_rows`` training texts) and are then trained on all
training texts, whole, each in one of ``FIT_ROUNDS`` rounds: windows are dealt
by hash to buckets whose number grows with the corpus, tasks train a copy of the
model on each bucket, and the copies are averaged (an id's vector by how often a
bucket has the id).  The result does not depend on how the table is split.  The
scoring pass keeps a broadcast table of the most frequent words (at most
``COMMON`` of them) and sends every other word to a join with the counts.

Defined results: null text is empty and scores its end alone; rows with null id
never train; repeated rows train and score as often as they occur; without
training rows N = V = 0 and both scores use uniform shares; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import written
from moodframe.llm.words import WordTable, cut_at_punctuation, lowered, mix, slices, utf8, word_bounds

WINDOW, OVERLAP = 32, 4
DIM, HIDDEN, CLASSES, OWN = 16, 16, 64, 48
#: Rounds that the training texts are split over, windows of a bucket and of a
#: step, and ids of a block of vectors.
FIT_ROUNDS, BUCKET, STEP, IDS = 2, 1 << 15, 256, 1024
#: Windows that go through the layers at once: their arrays stay in a core's cache.
CHUNK = 64
RATES = (0.004, 0.002)
#: Most frequent words that are broadcast (16 bytes each).
COMMON = 1 << 18
#: Words and ids counted by a task before it sends its sums on.
FLUSH = 1 << 20


class Subwords:
    """Ids of lower-cased texts by a byte-pair rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 2
        self.end = self.size - 1
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.table = WordTable(self.encode)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.bpe.encode_ordinary(w) for w in words]
        n = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.uint32, int(n.sum())), n

    def read(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id bounds) of a column of texts."""
        data, offsets = utf8(column)
        starts, ends, begins = cut_at_punctuation(data, *word_bounds(data, offsets))
        ids, n = self.table.ids(self.table.rows(lowered(data), starts, ends, begins))
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]

    def words(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, word bounds of the texts): a word is the ids from one
        that begins with a space to the next, and no other word has the same."""
        starts = np.flatnonzero(self.begins[ids])
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
        each = mix(ids.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(32)), 45)
        return np.add.reduceat(each, starts), np.searchsorted(starts, bounds)


_tables: dict[str, Subwords] = {}


def subwords(path: str, pattern: str) -> Subwords:
    if path not in _tables:
        _tables[path] = Subwords(path, pattern)
    return _tables[path]


class Model:
    """Parameters and forward pass; ``x`` is a batch of windows of ids."""

    NAMES = ("emb", "pos", "wq", "wk", "wv", "w1", "b1", "w2", "b2")

    def __init__(self, vocab: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        f = lambda *s: (rng.standard_normal(s) / math.sqrt(s[0])).astype(np.float32)
        self.emb = (rng.standard_normal((vocab, DIM)) * 0.5).astype(np.float32)
        self.pos = (rng.standard_normal((WINDOW, DIM)) * 0.1).astype(np.float32)
        self.wq, self.wk, self.wv = f(DIM, DIM), f(DIM, DIM), f(DIM, DIM)
        self.w1, self.b1 = f(DIM, HIDDEN), np.zeros(HIDDEN, np.float32)
        self.w2, self.b2 = f(HIDDEN, CLASSES), np.zeros(CLASSES, np.float32)
        self.cls = np.zeros(vocab, np.int64)
        self.within = np.zeros(vocab)  # ln share of an id within its class

    def set_classes(self, counts: np.ndarray, begins: np.ndarray, end: int) -> None:
        """Own classes for the end id and the most frequent ids; the rest in
        classes of about equal mass, apart by whether an id begins a word."""
        order = np.argsort(-counts, kind="stable")
        own = np.concatenate([[end], order[order != end][: OWN - 1]])
        self.cls[own] = np.arange(OWN)
        rest = order[~np.isin(order, own)]
        half = (CLASSES - OWN) // 2
        for k, part in enumerate((rest[begins[rest]], rest[~begins[rest]])):
            if len(part):
                mass = np.cumsum(counts[part] + 0.1)
                self.cls[part] = OWN + k * half + np.minimum((mass / mass[-1] * half).astype(np.int64), half - 1)
        share = counts + 0.1
        self.within = np.log(share / np.bincount(self.cls, share, CLASSES)[self.cls])

    def mixing(self) -> np.ndarray:
        """Attention between two positions is h_i @ mixing @ h_j."""
        return (self.wq @ self.wk.T) * (1 / math.sqrt(DIM))

    def attended(self, x: np.ndarray, mixing: np.ndarray) -> np.ndarray:
        """Vectors after the attention layer: weights are bounded instead of lowered
        by their largest, and a column of ones sums them in the same product."""
        n, kind = len(x), self.emb.dtype
        room = lambda name, *shape: _room(name, shape, kind)
        h = np.take(self.emb, x, 0, room("h", n, WINDOW, DIM), "clip")
        h += self.pos
        flat = h.reshape(-1, DIM)
        hm = np.matmul(flat, mixing, out=room("hm", n * WINDOW, DIM)).reshape(h.shape)
        a = np.matmul(hm, h.transpose(0, 2, 1), out=room("e", n, WINDOW, WINDOW))
        np.minimum(a, np.float32(30), out=a)
        np.exp(a, out=a)
        a *= CAUSAL
        v = room("v", n, WINDOW, DIM + 1)
        v[:, :, :DIM] = np.matmul(flat, self.wv, out=room("hv", n * WINDOW, DIM)).reshape(h.shape)
        v[:, :, DIM] = 1
        got = np.matmul(a, v, out=room("got", n, WINDOW, DIM + 1))
        h += np.multiply(got[:, :, :DIM], 1 / np.maximum(got[:, :, DIM:], np.float32(1e-30)), out=hm)
        return h

    def class_scores(self, h: np.ndarray) -> np.ndarray:
        """Scores of the classes of the next id, of vectors after attention."""
        u = np.matmul(h, self.w1, out=_room("hid", (len(h), HIDDEN), h.dtype))
        u += self.b1
        one = _room("u", (len(h), HIDDEN + 1), h.dtype)
        np.maximum(u, 0, out=one[:, :HIDDEN])
        one[:, HIDDEN] = 1
        return np.matmul(one, np.vstack([self.w2, self.b2]), out=_room("p", (len(h), CLASSES), h.dtype))

    def log_shares(self, x: np.ndarray, y: np.ndarray, first: int) -> np.ndarray:
        """ln P of the next ids ``y`` [b, WINDOW - first] after positions >= first."""
        mixing, c, out = self.mixing(), self.cls[y], np.empty(y.shape)
        for i in range(0, len(x), CHUNK):
            part = c[i : i + CHUNK]
            z = self.class_scores(self.attended(x[i : i + CHUNK], mixing)[:, first:].reshape(-1, DIM))
            np.clip(z, -60, 60, out=z)
            picked = z.reshape(-1)[np.arange(0, z.size, CLASSES) + part.reshape(-1)]
            np.exp(z, out=z)
            out[i : i + CHUNK] = (picked - np.log(z @ np.ones(CLASSES, z.dtype))).reshape(part.shape)
        return out + self.within[y]

    def gradient(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Mean class loss over the real targets and its gradient."""
        loss, g, rows = self.slopes(x, y, real)
        sums, g["emb"] = g["emb"], np.zeros_like(self.emb)
        g["emb"][rows] = sums
        return loss, g

    def slopes(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """``gradient`` with the vectors' part for the ids of ``x`` alone, which
        come third.  Windows go through in chunks that a core's cache holds."""
        n = max(1, int(real.sum()))
        kind = self.emb.dtype
        mixing, w2 = self.mixing(), np.vstack([self.w2, self.b2])
        sums = [np.zeros((DIM, DIM), kind), np.zeros((DIM, DIM), kind), np.zeros((DIM, HIDDEN), kind), np.zeros(HIDDEN, kind), np.zeros(CLASSES, kind), np.zeros((HIDDEN, CLASSES), kind)]
        dh = np.empty((*x.shape, DIM), kind)
        loss = 0.0
        for i in range(0, len(x), CHUNK):
            at = slice(i, i + CHUNK)
            loss += self._chunk(x[at], self.cls[y[at]], real[at], mixing, w2, sums, dh[at])
        dh /= n
        for one in sums:
            one /= n
        mix_g, wv, w1, b1, b2, w2 = sums
        scale = 1 / math.sqrt(DIM)
        g = {"pos": dh.sum(0), "wq": mix_g @ self.wk * scale, "wk": mix_g.T @ self.wq * scale, "wv": wv, "w1": w1, "b1": b1, "w2": w2, "b2": b2}
        held = np.zeros(len(self.emb), bool)
        held[x] = True
        ids = np.flatnonzero(held)
        place = np.zeros(len(self.emb), np.int64)
        place[ids] = np.arange(0, DIM * len(ids), DIM)
        cell = place[x.reshape(-1)][:, None] + np.arange(DIM)
        g["emb"] = np.bincount(cell.reshape(-1), dh.reshape(-1), DIM * len(ids)).reshape(-1, DIM).astype(kind)
        return loss / n, g, ids

    def _chunk(self, x: np.ndarray, c: np.ndarray, real: np.ndarray, mixing: np.ndarray, w2: np.ndarray, sums: list[np.ndarray], dh: np.ndarray) -> float:
        """Loss of a chunk, summed; adds its slopes to ``sums`` and sets ``dh``, the
        slopes of its positions' vectors.  Weights stay undivided by their sums
        (``e``, ``p``): the rows beside them are divided instead."""
        n, kind = len(x), self.emb.dtype
        room = lambda name, *shape: _room(name, shape, kind)
        flat = lambda m: m.reshape(-1, m.shape[2])
        ones = np.ones(CLASSES, kind)
        h = np.take(self.emb, x, 0, room("h", n, WINDOW, DIM), "clip")
        h += self.pos
        hm = np.matmul(flat(h), mixing, out=room("hm", n * WINDOW, DIM)).reshape(h.shape)
        v = room("v", n, WINDOW, DIM + 1)
        v[:, :, :DIM] = np.matmul(flat(h), self.wv, out=room("hv", n * WINDOW, DIM)).reshape(h.shape)
        v[:, :, DIM] = 1
        e, got = room("e", n, WINDOW, WINDOW), room("got", n, WINDOW, DIM + 1)
        for lower in (False, True):
            np.matmul(hm, h.transpose(0, 2, 1), out=e)
            _exp(e, lower)
            e *= CAUSAL
            np.matmul(e, v, out=got)
            if _in_range(got[:, :, DIM]):
                break
        r = 1 / np.maximum(got[:, :, DIM:], 1e-30)
        o = np.multiply(got[:, :, :DIM], r, out=room("o", *h.shape))
        s = flat(np.add(h, o, out=room("s", *h.shape)))
        hid = np.matmul(s, self.w1, out=room("hid", len(s), HIDDEN))
        hid += self.b1
        np.maximum(hid, 0, out=hid)
        u = room("u", len(s), HIDDEN + 1)
        u[:, :HIDDEN] = hid
        u[:, HIDDEN] = 1
        at = np.arange(0, len(s) * CLASSES, CLASSES) + c.reshape(-1)
        p = room("p", len(s), CLASSES)
        for lower in (False, True):
            np.matmul(u, w2, out=p)
            if lower:
                p -= p.max(1, keepdims=True)
            picked = p.reshape(-1)[at]
            _exp(p, False)
            total = p @ ones
            if _in_range(total):
                break
        w = real.reshape(-1)
        loss = -float(((picked - np.log(total)) * w).sum())
        p.reshape(-1)[at] -= total
        share = (w / total).astype(kind)
        sums[4] += share @ p
        du = np.matmul(p, self.w2.T, out=room("du", len(s), HIDDEN))
        du *= share[:, None]
        du *= hid > 0
        hid *= share[:, None]
        sums[5] += hid.T @ p
        sums[2] += s.T @ du
        sums[3] += np.ones(len(du), kind) @ du
        ds = np.matmul(du, self.w1.T, out=room("ds", len(s), DIM)).reshape(h.shape)
        d, dr = room("d", n, WINDOW, DIM + 1), np.multiply(ds, r, out=room("dr", *h.shape))
        d[:, :, :DIM] = dr
        o *= dr
        d[:, :, DIM] = (flat(o) @ -ones[:DIM]).reshape(n, WINDOW)
        de = np.matmul(d, v.transpose(0, 2, 1), out=room("de", *e.shape))
        de *= e
        dv = flat(np.matmul(e.transpose(0, 2, 1), dr, out=room("dv", *h.shape)))
        dm = flat(np.matmul(de, h, out=room("dm", *h.shape)))
        sums[0] += flat(h).T @ dm
        sums[1] += flat(h).T @ dv
        np.matmul(de.transpose(0, 2, 1), hm, out=dh)
        dh += ds
        dh += np.matmul(dm, mixing.T, out=flat(hm)).reshape(h.shape)
        dh += np.matmul(dv, self.wv.T, out=flat(hm)).reshape(h.shape)
        return loss

    def train(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, steps: int, batch: int = 96, rate: float = 0.01, seed: int = 0, once: bool = False) -> list[float]:
        """Adam over random batches of windows (``once``: over consecutive ones);
        the rate falls linearly.  A step moves the vectors of its own ids."""
        rng = np.random.default_rng(seed)
        layers = [n for n in self.NAMES if n != "emb"]
        # the layers lie in one array, so that one update moves them all
        flat, at = np.concatenate([getattr(self, n).reshape(-1) for n in layers]), 0
        for name in layers:
            own = getattr(self, name)
            setattr(self, name, flat[at : at + own.size].reshape(own.shape))
            at += own.size
        moved = [(flat[:, None], np.zeros((len(flat), 2), flat.dtype)), (self.emb, np.zeros((len(self.emb), 2 * DIM), flat.dtype))]
        losses = []
        for step in range(1, steps + 1):
            pick = slice((step - 1) * batch, step * batch) if once else rng.integers(0, len(x), batch)
            loss, g, ids = self.slopes(x[pick], y[pick], real[pick])
            losses.append(loss)
            lr = rate * (1 - (step - 1) / steps)
            new = np.concatenate([g[n].reshape(-1) for n in layers])[:, None], g["emb"]
            for (own, moments), slope, rows in zip(moved, new, (np.arange(len(flat)), ids)):
                held, wide = np.take(moments, rows, 0, mode="clip"), own.shape[1]
                a, b = held[:, :wide], held[:, wide:]
                a += 0.1 * (slope - a)
                slope *= slope
                b += 0.01 * (slope - b)
                moments[rows] = held
                by = b * (1 / (1 - 0.99**step))
                np.sqrt(by, out=by)
                by += 1e-8
                np.divide(a, by, out=by)
                by *= lr / (1 - 0.9**step)
                own[rows] = np.take(own, rows, 0, mode="clip") - by
        return losses


_rooms: dict[tuple, np.ndarray] = {}


def _room(name: str, shape: tuple, kind: np.dtype) -> np.ndarray:
    """An array of that shape whose memory every call for this name gives out."""
    size = math.prod(shape)
    held = _rooms.get((name, kind))
    if held is None or len(held) < size:
        held = _rooms[name, kind] = np.empty(size, kind)
    return held[:size].reshape(shape)


def _exp(z: np.ndarray, lower: bool) -> None:
    """Powers in place, of rows lowered by their largest if asked for."""
    if lower:
        z -= z.max(-1, keepdims=True)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(z, out=z)


def _in_range(sums: np.ndarray) -> bool:
    """Whether sums of powers are far from a float's bounds (and no NaN)."""
    return bool(sums.min() > 1e-25 and sums.max() < 1e25)


CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def windows(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows over texts laid one after another.

    Text t has ids[bounds[t]:bounds[t + 1]]; it is read after one end id and
    ends with one.  Returns (inputs [w, WINDOW], targets, scored, text of each
    window): ``scored`` marks the targets that this window scores."""
    n = np.diff(bounds) + 1  # targets of each text
    stride = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(n - WINDOW) // stride))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    # the sequence of text t: end, ids, end, at place bounds[t] + 2 t
    seq = np.full(len(ids) + 2 * len(n), end, np.int64)
    if len(ids):
        seq[np.arange(len(ids)) + 2 * np.repeat(np.arange(len(n)), np.diff(bounds)) + 1] = ids
    at = nth[:, None] * stride + np.arange(WINDOW)  # position in the text
    inside = at < n[text][:, None]
    place = (bounds[:-1] + 2 * np.arange(len(n)))[text][:, None] + np.where(inside, at, 0)
    scored = inside & ((nth[:, None] == 0) | (np.arange(WINDOW) >= OVERLAP))
    return seq[place], seq[place + 1], scored, text


def score_texts(model: Model, ids: np.ndarray, bounds: np.ndarray, end: int, batch: int = 512) -> np.ndarray:
    """ln P of each text."""
    out = np.zeros(len(bounds) - 1)
    x, y, scored, text = windows(ids, bounds, end)
    later = np.flatnonzero(~scored[:, 0])  # windows after a text's first
    for rows, first in ((np.flatnonzero(scored[:, 0]), 0), (later, OVERLAP)):
        for i in range(0, len(rows), batch):
            r = rows[i : i + batch]
            got = model.log_shares(x[r], y[r][:, first:], first) * scored[r][:, first:]
            out += np.bincount(text[r], got.sum(1), len(out))
    return out


def _laid_out(sub: Subwords, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word bounds, ids, id bounds) of a column of texts."""
    ids, at = sub.read(column)
    return *sub.words(ids, at), ids, at


def read_texts(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows`` with ``ids`` (those of a whole text, see ``_id_type``) in place of
    ``text``, written: later steps read them and no text again."""
    kind = _id_type(subwords(path, pattern))
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        for batch in batches:
            for b in slices(batch, "text"):
                ids, at = sub.read(b.column("text"))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _binary(ids.astype(kind), at)], names=[*keep, "ids"])

    schema = rows.select(*keep, F.lit(None).cast("binary").alias("ids")).schema
    return written(rows.mapInArrow(run, schema), "lm-ids", compression="zstd")


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values as bytes."""
    offsets = (np.asarray(bounds) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of what ``_binary`` made."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def count_corpus(read: DataFrame, path: str, pattern: str) -> DataFrame:
    """(kind, key, n): kind 0 word hash, 1 subword id, 2 the number of texts."""
    kind = _id_type(subwords(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        kept: list[np.ndarray] = []
        id_counts = np.zeros(sub.size, np.int64)
        texts = 0
        for batch in batches:
            for b in slices(batch, "ids"):
                ids, at = _values(b.column("ids"), kind)
                kept.append(sub.words(ids, at)[0])
                id_counts += np.bincount(ids, minlength=sub.size)
                texts += b.num_rows
                if sum(map(len, kept)) >= FLUSH:
                    yield _sums(kept)
                    kept = []
        if kept:
            yield _sums(kept)
        seen = np.flatnonzero(id_counts)
        yield _rows(1, seen, id_counts[seen])
        yield _rows(2, np.zeros(1, np.int64), np.array([texts]))

    def _sums(kept: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(kept), return_counts=True)
        return _rows(0, key.view(np.int64), n)

    def _rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"]
        )

    return read.select("ids").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def fit_windows(read: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """(bucket, key, window) of all windows of texts (id, ids); a window is its
    WINDOW + 1 ids and the bits of its scored targets."""
    kind = _id_type(subwords(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub = subwords(path, pattern)
        for batch in batches:
            for b in slices(batch, "ids"):
                ids, at = _values(b.column("ids"), kind)
                x, y, scored, text = windows(ids, at, sub.end)
                nth = np.arange(len(text)) - np.searchsorted(text, text)
                own = b.column("key").to_numpy().astype(np.int64).view(np.uint64)[text]
                key = mix(own + nth.astype(np.uint64), 43)
                raw = np.concatenate([np.concatenate([x, y[:, -1:]], 1).astype(kind).view(np.uint8), np.packbits(scored, 1)], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key % np.uint64(buckets)).astype(np.int32)), pa.array(key.view(np.int64)), _binary(raw, np.arange(len(raw) + 1) * raw.shape[1])],
                    names=["bucket", "key", "window"],
                )

    keyed = read.select(F.xxhash64(F.lit(44), "id").alias("key"), "ids")
    return keyed.mapInArrow(run, "bucket int, key long, window binary")


def _id_type(sub: Subwords) -> type:
    """The narrowest whole number that holds every id."""
    return np.uint16 if sub.size <= 1 << 16 else np.uint32


def _read_windows(raw: list[np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = np.dtype(kind).itemsize * (WINDOW + 1)
    rows = np.concatenate(raw).reshape(-1, width + WINDOW // 8)
    ids = np.ascontiguousarray(rows[:, :width]).view(kind).astype(np.int64)
    return ids[:, :-1], ids[:, 1:], np.unpackbits(rows[:, width:], 1)[:, :WINDOW].astype(bool)


def train_round(model: Model, read: DataFrame, path: str, pattern: str, buckets: int, rate: float) -> None:
    """Train ``model`` on all windows of texts (id, ids): a copy per bucket, averaged."""
    shared = read.sparkSession.sparkContext.broadcast(model)
    layers = [n for n in Model.NAMES if n != "emb"]
    kind = _id_type(subwords(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        emb, used = np.zeros(start.emb.shape, np.float64), np.zeros(len(start.emb))
        rest, n = {name: np.zeros(getattr(start, name).shape) for name in layers}, 0

        def learn(raw: list[np.ndarray]) -> None:
            nonlocal n
            copy = Model.__new__(Model)
            copy.cls, copy.within = start.cls, start.within
            for name in Model.NAMES:
                setattr(copy, name, getattr(start, name).copy())
            x, y, real = _read_windows(raw, kind)
            copy.train(x, y, real, -(-len(x) // STEP), STEP, rate, once=True)
            seen = np.bincount(x.reshape(-1), minlength=len(used)).astype(float)
            emb[:] += (copy.emb - start.emb) * seen[:, None]
            used[:] += seen
            for name in layers:
                rest[name] += (getattr(copy, name) - getattr(start, name)) * float(len(x))
            n += len(x)

        held, at = [], None
        for b in batches:
            bucket, (window, bounds) = b.column("bucket").to_numpy(), _values(b.column("window"), np.uint8)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            for a, z in zip(cuts, cuts[1:]):
                if a == z:
                    continue
                if held and bucket[a] != at:
                    learn(held)
                    held = []
                at = bucket[a]
                held.append(window[bounds[a] : bounds[z]])
        if held:
            learn(held)
        if n:
            found = [(-1, float(n), np.concatenate([rest[name].reshape(-1) for name in layers]))]
            for i in range(0, len(used), IDS):
                if used[i : i + IDS].any():
                    found.append((i // IDS, 0.0, np.concatenate([used[i : i + IDS], emb[i : i + IDS].reshape(-1)])))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found]), pa.array([f[2].tobytes() for f in found], pa.binary())], names=["block", "n", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["sums"].iloc[0]) // 8)
        for raw in pdf["sums"]:
            total += np.frombuffer(raw)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [pdf["n"].sum()], "sums": [total.tobytes()]})

    dealt = fit_windows(read, path, pattern, buckets).repartitionById(min(buckets, 1024), "bucket").sortWithinPartitions("bucket", "key")
    sums = dealt.mapInArrow(run, "block int, n double, sums binary")
    # one row a block of ids: as much as the model
    for r in sums.groupBy("block").applyInPandas(add, "block int, n double, sums binary").collect():
        total = np.frombuffer(bytes(r["sums"]))
        if r["block"] < 0:
            at = 0
            for name in layers:
                own = getattr(model, name)
                own += (total[at : at + own.size] / r["n"]).reshape(own.shape).astype(np.float32)
                at += own.size
        else:
            rows = slice(r["block"] * IDS, min((r["block"] + 1) * IDS, len(model.emb)))
            size = rows.stop - rows.start
            model.emb[rows] += (total[size:].reshape(size, -1) / np.maximum(total[:size], 1)[:, None]).astype(np.float32)
    shared.unpersist()


def fit_model(train: DataFrame, n_train: int, id_counts: np.ndarray, path: str, pattern: str, fit_rows: int = 1200, steps: int = 500, max_bytes: int = 32 << 10, seed: int = 7, read: DataFrame | None = None) -> Model:
    """Start the layers on at most ``fit_rows`` training texts of up to
    ``max_bytes`` bytes each, chosen by the hash of their id, and train them on
    all training texts, of any length, each in one round.  ``read``: the ids of
    ``train``, where they are already there (see ``read_texts``)."""
    sub = subwords(path, pattern)
    model = Model(sub.size, seed)
    model.set_classes(id_counts.astype(float), sub.begins, sub.end)
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    few = train.filter((part <= F.lit(3.0 * fit_rows / max(1, n_train))) & (F.octet_length("text") <= max_bytes))
    sample = [r["text"] for r in few.orderBy(F.xxhash64(F.lit(seed), "id"), "id", "text").limit(fit_rows).select("text").collect()]
    if sample:
        _, _, ids, at = _laid_out(sub, pa.array(sample, pa.string()))
        x, y, scored, _ = windows(ids, at, sub.end)
        model.train(x, y, scored, steps, seed=seed)
    turn = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(FIT_ROUNDS))
    count = (float(id_counts.sum()) / (WINDOW - OVERLAP) + n_train) / FIT_ROUNDS
    if n_train and read is None:
        read = read_texts(train.select("id", "text"), path, pattern)
    for r in range(FIT_ROUNDS if n_train else 0):
        train_round(model, read.filter(turn == r), path, pattern, max(1, math.ceil(count / BUCKET)), RATES[r])
    return model


def common_words(words: DataFrame, limit: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of at most ``limit`` words: all words above a
    count that a histogram over rounded logarithms gives."""
    level = F.floor(F.log(F.col("n").cast("double")) * 16).cast("int")
    histogram = {r["level"]: r["count"] for r in words.groupBy(level.alias("level")).count().collect()}  # < 700 rows
    total, lowest = 0, None
    for lv in sorted(histogram, reverse=True):
        if total + histogram[lv] > limit:
            break
        total, lowest = total + histogram[lv], lv
    if lowest is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = words.filter(level >= lowest).select("key", "n").toArrow()
    key = table["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], table["n"].to_numpy()[order]


def score_corpus(docs: DataFrame, held_out, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 1200, steps: int = 500) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per
    row; rows where ``held_out`` (a Column) is false are the training rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    read = read_texts(rows, path, pattern)
    trains = ~F.col("held_out") & F.col("id").isNotNull()
    counts = written(count_corpus(read.filter(trains), path, pattern), "lm-counts")
    words = counts.filter("kind = 0").select("key", "n")
    total, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    small = counts.filter("kind > 0").collect()  # <= one row per subword id
    n_train = sum(r["n"] for r in small if r["kind"] == 2)
    size = subwords(path, pattern).size
    id_counts = np.zeros(size, np.int64)
    for r in small:
        if r["kind"] == 1:
            id_counts[r["key"]] = r["n"]
    id_counts[size - 1] = n_train
    big_n, big_v = (total or 0) + n_train, (distinct or 0) + (1 if n_train else 0)
    model = fit_model(rows.filter(trains), n_train, id_counts, path, pattern, fit_rows, steps, read=read.filter(trains))
    known, known_n = common_words(words)
    shared = spark.sparkContext.broadcast((model, known, np.log10(known_n + 0.1)))
    end_share = math.log10(n_train + 0.1)
    kind = _id_type(subwords(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, share = shared.value
        sub = subwords(path, pattern)
        number = 0
        for batch in batches:
            for b in slices(batch, "ids"):
                ids, id_at = _values(b.column("ids"), kind)
                word, at = sub.words(ids, id_at)
                score = score_texts(model, ids, id_at, sub.end) / math.log(10)
                # sorted words are looked up several times as fast
                order, near = np.argsort(word), np.empty(len(word), np.int64)
                near[order] = np.minimum(np.searchsorted(known, word[order]), max(0, len(known) - 1))
                hit = known[near] == word if len(known) else np.zeros(len(word), bool)
                text = np.repeat(np.arange(b.num_rows), np.diff(at))
                sums = np.bincount(text[hit], share[near[hit]], b.num_rows)
                seen = np.bincount(text[hit], minlength=b.num_rows)
                rare = word[~hit].view(np.int64)
                rare_at = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=b.num_rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + b.num_rows)),
                        b.column("id"),
                        b.column("held_out"),
                        b.column("part"),
                        pa.array(np.diff(at) + 1),
                        pa.array(seen.astype(np.int64)),
                        pa.array(sums.astype(float)),  # numpy counts nothing in whole numbers
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(rare_at.astype(np.int32)), pa.array(rare)),
                    ],
                    names=["number", "id", "held_out", "part", "n_tokens", "seen", "sums", "score", "rare"],
                )
                number += b.num_rows

    frame = read.withColumn("part", F.spark_partition_id())
    id_type = frame.schema["id"].dataType.simpleString()
    scored = written(
        frame.mapInArrow(run, f"number long, id {id_type}, held_out boolean, part int, n_tokens long, seen long, sums double, score double, rare array<bigint>"),
        "lm-scored",
    )
    # every other word meets its count in a join; both sides are keyed by the word
    rare = scored.select("part", "number", F.explode("rare").alias("key"))
    met = rare.join(words, "key", "left").groupBy("part", "number").agg(
        F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1))).alias("more_sums")
    )
    out = scored.drop("rare").join(met, ["part", "number"], "left")
    base = F.col("sums") + F.coalesce("more_sums", F.lit(0.0)) + F.lit(end_share)
    scale = math.log10(big_n + 0.1 * (big_v + 1))
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        (F.col("seen") + F.coalesce("more", F.lit(0)) + F.lit(1 if n_train else 0)).cast("bigint").alias("n_known"),
        F.lit(big_n).cast("bigint").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        "score",
    )
