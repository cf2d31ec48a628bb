"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct five-word shingles (A-Z lowered); with
fewer words, the whole sequence is the one shingle.  Documents are linked when
100 * intersection >= 75 * union, and a component is everything reachable.

1. One pass over the texts gives each row its set size, a 128-bit key of the
   whole set and a MinHash signature.  Equal sets collapse to one vertex before
   anything is paired, whatever the rows' ids.
2. Signatures are banded; only buckets with two vertices or more go on.
3. A pair's signatures are compared batch by batch; it is dropped as soon as
   the posterior probability of a similarity of at least the threshold (uniform
   prior) falls under ``miss``.
4. First every member of a bucket meets a few hubs of its buckets, and its
   likeliest hub of either kind is confirmed on the full sets.  Then the members
   outside a bucket's largest component meet all of the bucket, in blocks whose
   signatures are compared inside a task; what leaves the task are the members
   that have a partner, not the pairs.  Their full sets meet once a block, where
   a member's intersections with all others are counted at once through the
   block's shingles, and only links that join two components leave the task.
   Pairs inside one component need no test, so a group of thousands of near
   copies costs a few tests a member, no pair is ever a row, and no link between
   components is left out.

Parameters: 24 bands of 4 of 128 hashes miss a pair at similarity 0.75 with a
probability of 1.1e-4 (less above); ``miss`` is 1e-4 a batch.

Defined results: null, empty or blank text has the empty set and is linked
with nothing; rows that repeat a doc_id are rows of their own, with equal or
with different texts; rows with null doc_id are compared like others, but are
nobody's smallest id, so a component of such rows alone has a null one; a row
without doc_id is kept where its component has no other; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.graph import components
from moodframe.llm.store import with_columns, written
from moodframe.llm.words import mix, slices, word_hashes

WORDS = 5
HASHES, BANDS, BAND_ROWS, BATCH = 128, 24, 4, 16
PERCENT = 75
MISS = 1e-4
#: Hubs of either kind that a document is compared with.
HUBS = 3
#: Members of a left and a right block of a bucket.
LEFT, RIGHT = 256, 2048
#: Shingles (8 bytes each) of a left or right block, and pairs compared at once.
SHINGLES, PAIRS = 1 << 20, 1 << 19
#: At most so many ids (8 bytes each) are broadcast to pick out candidate texts.
BROADCAST_IDS = 1_000_000

_PLACE = mix(np.arange(WORDS, dtype=np.uint64), 3) | np.uint64(1)
_A = mix(np.arange(HASHES, dtype=np.uint64), 5) | np.uint64(1)
_B = mix(np.arange(HASHES, dtype=np.uint64), 7)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    h, at = word_hashes(column)
    with np.errstate(over="ignore"):
        runs = np.zeros(0, np.uint64)
        if len(h) >= WORDS:
            total = np.zeros(len(h) - WORDS + 1, np.uint64)
            for k in range(WORDS):
                total += h[k : len(h) - WORDS + 1 + k] * _PLACE[k]
            runs = mix(total, 1)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            n = b - a
            if n >= WORDS:
                out.append(np.unique(runs[a : b - WORDS + 1]))
            elif n:
                out.append(mix(np.array([(h[a:b] * _PLACE[:n]).sum() + np.uint64(n)], np.uint64), 2))
            else:
                out.append(runs[:0])
    return out


def sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures uint32 [n, HASHES], set keys uint64 [n, 2]) of non-empty sets."""
    x = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), first)
    return out, set_keys(sets)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit keys, uint64 [n, 2], of non-empty sets."""
    x = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(x, salt), first) for salt in (21, 22)], 1)


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, k1, k2, sig) of (row, doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = shingle_sets(b.column("text"))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig: list[bytes | None] = [None] * len(sets)
                keys = np.zeros((len(sets), 2), np.uint64)
                if len(full):
                    signed, keys[full] = sign([sets[i] for i in full])
                    for i, s in zip(full.tolist(), signed):
                        sig[i] = s.tobytes()
                keys = keys.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("row"), b.column("doc_id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sig, pa.binary())],
                    names=["row", "doc_id", "n_shingles", "k1", "k2", "sig"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def banded(signed: DataFrame) -> DataFrame:
    """(doc, n_shingles, bucket): a bucket is a hash of a band's number and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bucket = _buckets(_matrix(b.column("sig")))
            each = [pa.array(np.repeat(b.column(c).to_numpy(), BANDS)) for c in ("doc", "n_shingles")]
            yield pa.RecordBatch.from_arrays([*each, pa.array(bucket.reshape(-1))], names=["doc", "n_shingles", "bucket"])

    return signed.select("doc", "n_shingles", "sig").mapInArrow(run, "doc long, n_shingles long, bucket long")


def _buckets(sig: np.ndarray) -> np.ndarray:
    """Bucket of each signature and band, int64 [n, BANDS]."""
    rows = sig[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        total = (rows * _PLACE[:BAND_ROWS]).sum(2) + mix(np.arange(BANDS, dtype=np.uint64), 9)
    return mix(total, 4).view(np.int64)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def fewest_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """Least number of agreements in ``n`` hashes that keeps a pair: with a
    uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def judged(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b, kind, matches) of the (a, b, kind) pairs that survive every batch."""
    steps = [(n, fewest_matches(n)) for n in range(BATCH, HASHES + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _matrix(b.column("sig_a")), _matrix(b.column("sig_b"))
            alive = np.arange(len(x))
            matches = np.zeros(len(x), np.int64)
            for n, fewest in steps:
                matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(1)
                alive = alive[matches[alive] >= fewest]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(alive)) for c in ("a", "b", "kind")], pa.array(matches[alive])], names=["a", "b", "kind", "matches"])

    both = (
        pairs.join(signed.select(F.col("doc").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
        .join(signed.select(F.col("doc").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
        # sets of too different sizes cannot reach the threshold
        .filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    )
    return both.select("a", "b", "kind", "sig_a", "sig_b").mapInArrow(run, "a long, b long, kind int, matches long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) by exact intersection of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for p, q in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                linked.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("shingles").alias("set_b")), "b"
    )
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, linked boolean")


def full_sets(texts: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """(doc, shingles) of the vertices in ``wanted`` (doc, doc_id, k1, k2,
    n_shingles): the sets of the rows with their ids are made again, and found
    by their keys, as an id may stand for several texts."""
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    ids = F.broadcast(ids) if n_wanted <= BROADCAST_IDS else ids
    few = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = [x for x in shingle_sets(b.column("text")) if len(x)]
                if sets:
                    keys = set_keys(sets).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())],
                        names=["k1", "k2", "n_shingles", "shingles"],
                    )

    made = few.select("text").mapInArrow(run, "k1 long, k2 long, n_shingles long, shingles binary")
    keyed = wanted.select("doc", "k1", "k2", "n_shingles")
    keyed = F.broadcast(keyed) if n_wanted <= BROADCAST_IDS // 4 else keyed
    return made.join(keyed, ["k1", "k2", "n_shingles"]).select("doc", "shingles").dropDuplicates(["doc"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, vertices): rows are (row, doc_id, n_shingles, k1, k2); vertices
    are (k1, k2, n_shingles, doc, doc_id, component, low), one for each
    different set, with its smallest doc_id and that of its component."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = written(signatures(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")), "neardup-rows")
    signed = written(
        rows.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("row").alias("doc"), F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")),
        "neardup-signed",
    )
    buckets = banded(signed)
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = written(buckets.join(shared, "bucket"), "neardup-members")
    wanted = written(signed.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "doc_id", "k1", "k2", "n_shingles"), "neardup-wanted")
    n_wanted = wanted.count()
    vertices = signed.select("k1", "k2", "n_shingles", "doc", "doc_id")
    if n_wanted:
        labels = linked_classes(members, signed, full_sets(texts, wanted, n_wanted))
        placed = with_component(vertices, "doc", labels)
        low = placed.join(labels.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("doc_id").alias("low"))
        placed = placed.join(low, "component", "left").withColumn("low", F.coalesce("low", "doc_id"))
    else:
        placed = vertices.withColumn("component", F.col("doc")).withColumn("low", F.col("doc_id"))
    return rows.drop("sig"), placed.select("k1", "k2", "n_shingles", "doc", "doc_id", "component", "low")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    rows, vertices = classes(docs, id_col, text_col)
    out = rows.join(vertices.drop("doc_id"), ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("doc").isNull(), F.col("doc_id")).otherwise(F.col("low"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def with_set_keys(docs: DataFrame, text_col: str = "text", names: tuple[str, str, str] = ("n_shingles", "k1", "k2")) -> DataFrame:
    """``docs`` plus the size and the key of each text's set."""

    def each(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for b in slices(batch, at):
            sets = shingle_sets(b.column(at))
            n = np.array([len(x) for x in sets], np.int64)
            keys = np.zeros((len(sets), 2), np.uint64)
            if n.any():
                keys[n > 0] = set_keys([x for x in sets if len(x)])
            yield b, [pa.array(n), *[pa.array(keys.view(np.int64)[:, k].copy()) for k in (0, 1)]]

    return with_columns(docs, text_col, docs.columns, dict.fromkeys(names, "long"), each)


def linked_classes(members: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex with a link."""
    sets = written(sets, "neardup-sets")
    found = written(judged(hub_pairs(members), signed), "neardup-judged")
    # a member's likeliest hub of either kind is enough: what stays apart meets in blocks
    best = found.groupBy("a", "kind").agg(F.max_by("b", F.struct("matches", F.negative("b"))).alias("b"))
    labels = merged(None, written(confirmed(best.select("a", "b").distinct(), sets), "neardup-exact"))
    partnered = written(crossing_members(with_component(members, "doc", labels), signed), "neardup-crossing")
    return merged(labels, written(settled(partnered, sets), "neardup-settled"))


def merged(labels: DataFrame | None, exact: DataFrame) -> DataFrame:
    """Classes after the links of ``exact``: classes found so far count as
    vertices linked to their smallest."""
    links = (exact.filter("linked") if "linked" in exact.columns else exact).select("a", "b")
    if labels is not None:
        if links.isEmpty():
            return labels
        links = links.unionByName(labels.select(F.col("vertex").alias("a"), F.col("component").alias("b")))
    return written(components(links), "neardup-labels")


def with_component(rows: DataFrame, doc: str, labels: DataFrame) -> DataFrame:
    known = labels.withColumnRenamed("vertex", doc)
    return rows.join(known, doc, "left").withColumn("component", F.coalesce("component", doc))


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b, kind): each member with hubs of its buckets, which are a bucket's
    smallest id (kind 0) and one by hash (kind 1).  Of either kind the ``HUBS``
    that it shares most buckets with are enough, as nothing is given up here:
    what stays apart meets in ``crossing_pairs``."""
    hubs = members.groupBy("bucket").agg(F.min("doc").alias("low"), F.min_by("doc", F.xxhash64("doc")).alias("other"))
    met = members.join(hubs, "bucket").groupBy("doc").agg(F.collect_list("low").alias("low"), F.collect_list("other").alias("other"))  # <= BANDS each

    def most_shared(c: str):
        counted = F.transform(F.array_distinct(c), lambda h: F.struct(F.size(F.filter(c, lambda x: x == h)).alias("n"), F.negative(h).alias("b")))
        return F.slice(F.sort_array(F.filter(counted, lambda s: s["b"] != F.negative("doc")), asc=False), 1, HUBS)

    each = F.concat(_kind(most_shared("low"), 0), _kind(most_shared("other"), 1))
    return met.select(F.col("doc").alias("a"), F.inline_outer(each)).filter("b is not null").select("a", "b", "kind")


def _kind(hubs, kind: int):
    return F.transform(hubs, lambda s: F.struct(F.negative(s["b"]).alias("b"), F.lit(kind).alias("kind")))


def crossing_members(placed: DataFrame, signed: DataFrame) -> DataFrame:
    """(bucket, l, r, doc, component) of the members of blocks with a partner
    in another component whose signature survives.

    In each bucket the members outside its largest component meet all members,
    in blocks of at most about ``LEFT`` and ``RIGHT`` members and ``SHINGLES``
    shingles; a block's pairs are compared inside the task, each in the first
    band that it shares.
    """
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    main = sizes.groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max_by("s", F.struct("n", "component")).alias("most_s"),
        F.max("n").alias("most"), F.sum("n").alias("all"), F.sum("s").alias("all_s"), F.count(F.lit(1)).alias("parts"),
    )
    mixed = placed.drop("n_shingles").join(main.filter("parts > 1"), "bucket").join(signed.select("doc", "n_shingles", "sig"), "doc")
    parts = lambda n, most, s: F.greatest(F.ceil(n / F.lit(most)), F.ceil(s / F.lit(SHINGLES))).cast("int")
    lefts, rights = parts(F.col("all") - F.col("most"), LEFT, F.col("all_s") - F.col("most_s")), parts(F.col("all"), RIGHT, F.col("all_s"))
    part = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    stray = F.col("component") != F.col("main")
    # a stray goes to one left block (side 0) with every right one, any member to one right block (side 1) with every left one
    as_left = F.transform(every(rights), lambda r: F.struct(F.lit(0).alias("side"), part(lefts).alias("l"), r.alias("r")))
    as_right = F.transform(every(lefts), lambda l: F.struct(F.lit(1).alias("side"), l.alias("l"), part(rights).alias("r")))
    blocks = F.when(stray, F.concat(as_left, as_right)).otherwise(as_right)
    dealt = mixed.select("bucket", "doc", "component", "n_shingles", stray.alias("stray"), "sig", F.inline(blocks))
    steps = [(n, fewest_matches(n)) for n in range(BATCH, HASHES + 1, BATCH)]

    def partnered(t: pa.Table) -> np.ndarray:
        """Positions of the rows with a partner."""
        side, doc, own = (t[c].to_numpy() for c in ("side", "doc", "component"))
        n, lone, sig = t["n_shingles"].to_numpy(), t["stray"].to_numpy(), _matrix(t["sig"])
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        has = np.zeros(t.num_rows, bool)
        if not len(x) or not len(y):
            return np.flatnonzero(has)
        here = int(np.argmax(_buckets(sig[:1])[0] == t["bucket"][0].as_py()))
        # some left rows at a time: their pairs are at most PAIRS
        for lo in range(0, len(x), max(1, PAIRS // len(y))):
            i, j = (k.ravel() for k in np.meshgrid(x[lo : lo + max(1, PAIRS // len(y))], y, indexing="ij"))
            ok = (own[i] != own[j]) & (~lone[j] | (doc[i] > doc[j])) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            matches = np.zeros(len(i), np.int64)
            for k, (to, fewest) in enumerate(steps):
                matches += (sig[i, to - BATCH : to] == sig[j, to - BATCH : to]).sum(1)
                alive = matches >= fewest
                i, j, matches = i[alive], j[alive], matches[alive]
                if k == 0 and len(i):
                    wide = BANDS * BAND_ROWS
                    shared = (sig[i, :wide] == sig[j, :wide]).reshape(-1, BANDS, BAND_ROWS).all(2)
                    alive = shared.argmax(1) == here
                    i, j, matches = i[alive], j[alive], matches[alive]
            has[i] = has[j] = True
        at = np.flatnonzero(has)
        return at[np.unique(doc[at], return_index=True)[1]]  # a stray may stand on both sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "l", "r"]):
            at = partnered(t)
            if len(at):
                yield pa.RecordBatch.from_arrays([t[c].take(pa.array(at)).combine_chunks() for c in names], names=names)

    names = ["bucket", "l", "r", "doc", "component"]
    ordered = dealt.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r")
    return ordered.mapInArrow(run, "bucket long, l int, r int, doc long, component long")


def settled(partnered: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links between components, from the full sets of each block's
    members: at most one fewer than it has components."""

    def links(t: pa.Table) -> list[tuple[int, int]]:
        doc, own = t["doc"].to_numpy(), np.unique(t["component"].to_numpy(), return_inverse=True)[1]
        each = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["shingles"].combine_chunks()]
        n = np.array([len(x) for x in each])
        # postings: for each shingle the members that hold it
        key = np.concatenate(each)
        member = np.repeat(np.arange(len(each)), n)
        order = np.argsort(key, kind="stable")
        key, member = key[order], member[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        slot = np.empty(len(key), np.int64)
        slot[order] = np.repeat(np.arange(len(first)), length)
        bounds = np.concatenate([[0], np.cumsum(n)])
        root = np.arange(own.max() + 1)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        # a pair of two components has a member outside the block's largest one
        for i in np.flatnonzero(own != np.bincount(own).argmax()).tolist():
            mine = slot[bounds[i] : bounds[i + 1]]
            count = length[mine]
            total = np.cumsum(count)
            held = member[np.repeat(first[mine] - total + count, count) + np.arange(int(total[-1]))]
            common = np.bincount(held, minlength=len(each))
            near = np.flatnonzero(100 * common >= PERCENT * (n[i] + n - common))
            for j in near.tolist():
                p, q = find(own[i]), find(own[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((int(doc[i]), int(doc[j])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["bucket", "l", "r"]):
            if t.num_rows > 1:
                found = links(t)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    carried = partnered.join(sets, "doc").select("bucket", "l", "r", "doc", "component", "shingles")
    ordered = carried.repartition("bucket", "l", "r").sortWithinPartitions("bucket", "l", "r")
    return ordered.mapInArrow(run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal ``keys``, from batches sorted by them."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            v = t[k].to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(cuts[:-1], cuts[1:]):
            yield t.slice(a, z - a)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held
