"""Embedding near-duplicates on a neighbour graph refined by NN-descent.

1. Identical vectors collapse to one, whatever their ids.
2. Random hyperplane codes order the vectors.  Codes grow with the table, and
   the number of orders with them: ``orders_needed`` are made, so many that two
   vectors at the threshold share a code in one of them with probability
   ``target``.  Blocks of an order are compared in full and give each vector
   its first nearest neighbours; they end where a code ends, and a code that
   very many vectors share is cut, by a range partition over (order, code,
   projection), into as many half overlapping blocks as it needs.
3. NN-descent: a vector's neighbours and those it is a neighbour of meet in a
   join through it and are compared; better ones replace worse ones.  A list
   whose last neighbour is still a link is saturated and is enlarged, twice at
   most, to ``LISTED`` neighbours, so that a group of near copies does not hide
   what lies beyond it.  Each round also compares the blocks of new random orders.  Rounds go on while an audit (brute force for a bounded sample of vectors against
   all rows) finds a mean recall per linked vector below ``target``, over all
   or over those outside large components.  If that is still so after
   ``max_rounds``, an error names the measured recall.
4. Pairs at or above the threshold are links; connected components follow.
   Next to neighbour lists, every comparison block also reports which of its
   vectors are joined by links, so a saturated list loses no connection.
5. Links are counted exactly, in double precision, inside every component.  Vectors
   within half the threshold angle of the component's pivot are linked with
   each other for certain and are counted, not compared; all others meet the
   component in blocks of bounded size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links and are their own component; shorter vectors are read
as padded with zeros; rows repeating a vec_id are vectors of their own and are
linked like copies; rows with null vec_id are compared like others but are
nobody's smallest id, so a component of such rows alone has a null one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.graph import components
from moodframe.llm.store import written
from moodframe.llm.words import mix

BLOCK, GROUP = 256, 48
#: Neighbours listed, and the lengths that a saturated list is enlarged to.
LISTED = (10, 20, 40)
NEIGHBOURS = LISTED[0]
#: Orders whose edges are made before they are merged into the lists.
TREES = 12
#: Rows of a left and a right block in the exact count.
LEFT, RIGHT = 256, 4096
#: Vectors an audit starts with, linked ones outside components of more than
#: ``LARGE`` vectors that it wants, and the most that it samples.
AUDIT_ROWS, AUDIT_LINKED, AUDIT_MOST, LARGE = 512, 256, 1 << 14, 64


def _keyed(dim: int, kind: str):
    """Valid rows get a 128-bit key of their values and the vector's bytes."""
    bits_of = {"float32": np.uint32, "float64": np.uint64}[kind]
    place = mix(np.arange(dim, dtype=np.uint64), 43)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, n = b.column("vector"), b.num_rows
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            row = np.repeat(np.arange(n), lengths)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            x = np.zeros((n, dim), kind)
            x[row, at] = flat.to_numpy(zero_copy_only=False)  # a null becomes NaN
            wide = x.astype(np.float64)
            with np.errstate(all="ignore"):
                ok = np.isfinite(wide).all(1) & (wide != 0).any(1)
                x += x.dtype.type(0)  # -0.0 equals 0.0
                bits = x.view(bits_of).astype(np.uint64)
                keys = [mix(mix(bits, salt) + place, salt).sum(1).view(np.int64) for salt in (41, 42)]
            raw = [v.tobytes() if good else None for v, good in zip(x, ok.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("vec_id"), *[pa.array(k, mask=~ok) for k in keys], pa.array(raw, pa.binary())],
                names=["row", "vec_id", "k1", "k2", "vec"],
            )

    return run


def _units(column, dim: int) -> np.ndarray:
    """Unit vectors in double precision from bytes of either precision."""
    raw = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    kind = np.float64 if raw and len(raw[0]) == 8 * dim else np.float32
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    with np.errstate(over="ignore", under="ignore"):
        square = (x * x).sum(1)
        odd = ~np.isfinite(square) | (square < 1e-200)  # out of range: scaled by the largest value first
        if odd.any():
            x[odd] /= np.abs(x[odd]).max(1, keepdims=True)
            square = (x * x).sum(1)
    return x / np.sqrt(square)[:, None]


def _roots(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id that each row reaches over a block's links."""
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(1))
        if (low == root).all():
            return root
        root = low


def compare(ids: np.ndarray, unit: np.ndarray, threshold: float, top: int, worst: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(src, dst, similarity) of a block: each row's nearest ``top`` others
    (better than its ``worst``), and as similarity 2 the rows joined by links."""
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    sim[ids[:, None] == ids[None, :]] = -2
    out = []
    links = sim >= threshold
    if links.any():
        root = _roots(links, ids)
        joined = root < ids
        out.append((ids[joined], root[joined], np.full(int(joined.sum()), 2.0)))
    top = min(top, len(ids) - 1)
    if top > 0:
        near = np.argpartition(-sim, top - 1, 1)[:, :top]
        value = np.take_along_axis(sim, near, 1)
        ok = value > (-1.5 if worst is None else np.maximum(worst, -1.5)[:, None])
        row, col = np.nonzero(ok)
        out.append((ids[row], ids[near[row, col]], value[row, col]))
    return out


EDGES = "src long, dst long, sim double"


def _edges(found: list) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["src", "dst", "sim"])


def code_bits(n: int) -> int:
    return min(24, max(1, math.ceil(math.log2(max(2, n / BLOCK)))))


def orders_needed(n: int, threshold: float, target: float) -> int:
    """Orders in one of which a pair at the threshold shares its code with
    probability ``target``."""
    share = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** code_bits(n)
    return max(1, math.ceil(math.log(1 - target) / math.log1p(-share))) if 0 < share < 1 else 1


def order_graph(nodes: DataFrame, n: int, dim: int, threshold: float, first: int, count: int) -> DataFrame:
    """Edges from blocks of the hyperplane orders from ``first`` on."""
    bits = code_bits(n)
    planes = [np.random.default_rng((17, first + t)).standard_normal((bits + 1, dim)) for t in range(count)]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            unit = _units(b.column("vec"), dim)
            for tree in range(count):
                side = unit @ planes[tree].T
                code = ((side[:, :bits] > 0) << np.arange(bits)).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), tree, np.int32)), pa.array(code.astype(np.int64)), pa.array(side[:, bits]), b.column("doc"), b.column("vec")],
                    names=["tree", "code", "along", "doc", "vec"],
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            while held.num_rows > 2 * BLOCK:
                tree, code = (held.column(c).to_numpy()[: 2 * BLOCK + 1] for c in ("tree", "code"))
                ends = np.flatnonzero((tree[1:] != tree[:-1]) | (code[1:] != code[:-1])) + 1
                if len(ends):
                    yield from _block(held.slice(0, int(ends[-1])))
                    held = held.slice(int(ends[-1]))
                else:
                    yield from _block(held.slice(0, 2 * BLOCK))
                    held = held.slice(BLOCK)
        if held is not None and held.num_rows > 1:
            yield from _block(held)

    def _block(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, unit, tree = b.column("doc").to_numpy(), _units(b.column("vec"), dim), b.column("tree").to_numpy()
        found = []
        for t in np.unique(tree):
            m = tree == t
            if m.sum() > 1:
                found += compare(ids[m], unit[m], threshold, NEIGHBOURS)
        if found:
            yield _edges(found)

    ordered = nodes.select("doc", "vec").mapInArrow(order, "tree int, code long, along double, doc long, vec binary")
    return ordered.repartitionByRange("tree", "code", "along").sortWithinPartitions("tree", "code", "along").mapInArrow(blocks, EDGES)


def _allowed(near, threshold: float):
    """Length of a list, best first: enlarged while its last place is a link."""
    out = F.lit(LISTED[0])
    for short, longer in zip(LISTED, LISTED[1:]):
        out = F.when(F.get(near, F.lit(short - 1))["sim"] >= threshold, F.lit(longer)).otherwise(out)
    return out


def nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """(src, near): the best distinct neighbours, best first."""
    best = edges.filter("sim <= 1.5").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    listed = best.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("sim", "dst")), asc=False).alias("near"))
    return listed.select("src", F.slice("near", F.lit(1), _allowed(F.col("near"), threshold)).alias("near"))


def _merged(flat: DataFrame | None, stars: DataFrame | None, found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(neighbour lists one row an edge, links as stars (a, b), components) with
    the edges ``found`` added."""
    found = written(found, "vector-edges")
    near = nearest(found if flat is None else flat.unionByName(found), threshold)
    flat = written(near.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim")), "vector-lists")
    linked = found.filter(F.col("sim") >= threshold).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    links = written(components(linked if stars is None else stars.unionByName(linked)), "vector-components")
    return flat, links.select(F.col("vertex").alias("a"), F.col("component").alias("b")), links


def refine(lists: DataFrame, nodes: DataFrame, dim: int, threshold: float, salt: int) -> DataFrame:
    """Edges found among the neighbours (both ways) of each vector."""
    edges = lists.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"))
    both = edges.select(F.col("src").alias("mid"), F.col("dst").alias("doc")).unionByName(edges.select(F.col("dst").alias("mid"), F.col("src").alias("doc")))
    worst = lists.select(F.col("src").alias("doc"), F.when(F.size("near") < _allowed(F.col("near"), threshold), F.lit(-1.0)).otherwise(F.element_at("near", -1)["sim"]).alias("worst"))
    with_vec = nodes.select("doc", "vec").join(worst, "doc", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.0)))
    met = both.distinct().join(with_vec, "doc")
    # a vector that very many have as neighbour is dealt into groups of bounded size
    degree = both.distinct().groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
    dealt = met.join(degree, "mid").withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "doc"), F.ceil(F.col("n") / F.lit(GROUP))))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows >= 4096:
                cut = _last_group(held)
                if cut:
                    yield _groups(held.slice(0, cut))
                    held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield _groups(held)

    def _last_group(t: pa.Table) -> int:
        mid, part = t["mid"].to_numpy(), t["part"].to_numpy()
        change = np.flatnonzero((mid[1:] != mid[:-1]) | (part[1:] != part[:-1]))
        return int(change[-1]) + 1 if len(change) else 0

    def _groups(t: pa.Table) -> pa.RecordBatch:
        mid, part, ids, worst = (t[c].to_numpy() for c in ("mid", "part", "doc", "worst"))
        unit = _units(t["vec"], dim)
        edge = np.flatnonzero((mid[1:] != mid[:-1]) | (part[1:] != part[:-1])) + 1
        found = []
        for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
            if z - a > 1:
                found += compare(ids[a:z], unit[a:z], threshold, 4, worst[a:z])
        return _edges(found)

    return (
        dealt.select("mid", "part", "doc", "worst", "vec")
        .repartition("mid", "part")
        .sortWithinPartitions("mid", "part", "doc")
        .mapInArrow(local, EDGES)
    )


def audit(nodes: DataFrame, links: DataFrame, n: int, dim: int, threshold: float, rows: int = AUDIT_ROWS) -> tuple[float, int, int]:
    """(recall, linked vectors it rests on, sampled vectors).

    A sampled vector's recall is the share of its true links (brute force
    against all rows) that lie in its found component (links: vertex,
    component).  Vectors weigh alike, whatever their number of links, and the
    mean over those outside found components of more than ``LARGE`` vectors
    counts by itself, so that large groups do not hide lost pairs: the smaller
    of both means is returned.  The sample grows from ``rows`` until it holds
    ``AUDIT_LINKED`` linked vectors outside large components, up to
    ``AUDIT_MOST`` vectors or all."""
    size = links.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    placed = nodes.select("doc", "vec").join(links.withColumnRenamed("vertex", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    drawn = F.xxhash64(F.lit(23), "doc")
    share = F.pmod(drawn, F.lit(1 << 30)) / float(1 << 30)
    while True:
        few = placed.filter(share <= 2.0 * rows / max(1, n)).orderBy(drawn).limit(rows).join(size, "component", "left")
        sample = few.select("doc", "vec", "component", F.coalesce("size", F.lit(1)).alias("size")).collect()
        if not sample:
            return 1.0, 0, 0
        ids, own = (np.array([r[c] for r in sample], np.int64) for c in ("doc", "component"))
        unit = _units([bytes(r["vec"]) for r in sample], dim)

        def run(batches: Iterator[pa.RecordBatch], ids=ids, own=own, unit=unit) -> Iterator[pa.RecordBatch]:
            total, got = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for b in batches:
                for at in range(0, b.num_rows, AUDIT_ROWS):
                    part = b.slice(at, AUDIT_ROWS)
                    true = _units(part.column("vec"), dim) @ unit.T >= threshold
                    true &= part.column("doc").to_numpy()[:, None] != ids[None, :]
                    total += true.sum(0)
                    got += (true & (part.column("component").to_numpy()[:, None] == own[None, :])).sum(0)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(got[seen])], names=["at", "total", "got"])

        found = placed.mapInArrow(run, "at long, total long, got long").groupBy("at").agg((F.sum("got") / F.sum("total")).alias("recall")).collect()
        recall = np.array([r["recall"] for r in found])
        small = np.array([sample[r["at"]]["size"] <= LARGE for r in found], bool)
        if small.sum() >= AUDIT_LINKED or rows >= min(n, AUDIT_MOST):
            means = [float(recall[m].mean()) for m in (small, small | True) if m.any()]
            return min(means, default=1.0), len(found), len(sample)
        rows = min(4 * rows, n, AUDIT_MOST)


def counted(classes: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(doc, linked): copies of other vectors linked to each vector of a
    component, counted exactly."""
    inside = classes.join(nodes.select(F.col("doc").alias("vertex"), "copies", "vec"), "vertex")
    pivot = inside.filter("vertex = component").select("component", F.col("vec").alias("pivot"))
    margin = 1e-7
    half = math.cos(math.acos(threshold) / 2) + margin

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_units(b.column("vec"), dim) * _units(b.column("pivot"), dim)).sum(1) >= half
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near)], names=["component", "doc", "copies", "vec", "core"])

    rows = written(
        inside.join(pivot, "component")
        .select("component", F.col("vertex").alias("doc"), "copies", "vec", "pivot")
        .mapInArrow(core, "component long, doc long, copies long, vec binary, core boolean"),
        "vectors-inside",
    )
    total = rows.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("copies"))).alias("core_copies"),
        F.count(F.when(~F.col("core"), 1)).alias("outer"),
        F.count(F.lit(1)).alias("members"),
    )
    sized = rows.join(total, "component")
    certain = sized.filter("core").select("doc", (F.col("core_copies") - F.col("copies")).alias("linked"))
    # vectors outside the core, in blocks, each with the whole component, in blocks
    lefts, rights = F.ceil(F.col("outer") / F.lit(LEFT)), F.ceil(F.col("members") / F.lit(RIGHT))
    open_rows = sized.filter("outer > 0").select("component", "doc", "copies", "vec", "core", lefts.cast("int").alias("lefts"), rights.cast("int").alias("rights"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = open_rows.filter("not core").withColumn("l", F.pmod(F.xxhash64("doc"), F.col("lefts")).cast("int")).withColumn("r", spread(F.col("rights")))
    right = open_rows.withColumn("r", F.pmod(F.xxhash64("doc"), F.col("rights")).cast("int")).withColumn("l", spread(F.col("lefts")))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"doc": [], "linked": []})
        sim = _units(a["vec"], dim) @ _units(b["vec"], dim).T >= threshold
        sim &= a["doc"].to_numpy()[:, None] != b["doc"].to_numpy()[None, :]
        outer = sim @ b["copies"].to_numpy()
        is_core = b["core"].to_numpy()
        inner = a["copies"].to_numpy() @ sim[:, is_core]
        return pd.DataFrame({"doc": np.concatenate([a["doc"], b["doc"][is_core]]), "linked": np.concatenate([outer, inner])})

    columns = [F.col(c).alias(c) for c in ("component", "l", "r", "doc", "copies", "vec", "core")]
    met = left.select(*columns).groupBy("component", "l", "r").cogroup(right.select(*columns).groupBy("component", "l", "r"))
    compared = met.applyInPandas(count, "doc long, linked long")
    return certain.unionByName(compared).groupBy("doc").agg(F.sum("linked").alias("linked"))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    target: float = 0.99,
    min_rounds: int = 1,
    max_rounds: int = 6,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    kind = "float32" if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else "float64"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>").alias("vector"))
    dim = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector")
    keyed = written(numbered.mapInArrow(_keyed(dim, kind), "row long, vec_id long, k1 long, k2 long, vec binary"), "vectors")
    nodes = written(
        keyed.filter("vec is not null")
        .groupBy("k1", "k2")
        .agg(F.min("row").alias("doc"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")),
        "vector-nodes",
    )
    n = nodes.count()
    # fewer than two different vectors: nothing to compare
    flat = stars = links = None
    orders, rounds, due = 0, 0, orders_needed(n, threshold, target) if n > 1 else 0
    while n > 1:
        for _ in range(0, due, TREES):
            count = min(TREES, due)
            found = order_graph(nodes, n, dim, threshold, orders, count)
            orders, due = orders + count, due - count
            flat, stars, links = _merged(flat, stars, found, threshold)
        if rounds >= min_rounds:
            recall, linked, sampled = audit(nodes, links, n, dim, threshold)
            if recall >= target:
                break
            if rounds >= max_rounds:
                raise RuntimeError(f"recall {recall:.4f} of {linked} linked vectors among {sampled} is below {target} after {orders} orders and {rounds} rounds; raise max_rounds")
        lists = written(flat.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("sim", "dst")), asc=False).alias("near")), "vector-lists")
        flat, stars, links = _merged(flat, stars, refine(lists, nodes, dim, threshold, rounds), threshold)
        rounds += 1
        # as many new orders as there were, from the second round on
        due = orders if rounds > min_rounds else 0

    known = nodes.select("k1", "k2", "doc", "copies", "vec_id")
    if links is not None:
        known = known.join(links.withColumnRenamed("vertex", "doc"), "doc", "left").join(counted(links, nodes, dim, threshold), "doc", "left")
        low = known.filter("component is not null").groupBy("component").agg(F.min("vec_id").alias("low"))
        known = known.join(low, "component", "left").withColumn("low", F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("low")))
    else:
        known = known.withColumn("low", F.col("vec_id")).withColumn("linked", F.lit(0).cast("bigint"))
    out = keyed.select("vec_id", "k1", "k2").join(known.drop("vec_id"), ["k1", "k2"], "left")
    component = F.when(F.col("doc").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    n_links = F.coalesce(F.col("linked"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("bigint").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
