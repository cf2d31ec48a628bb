"""Approximate nearest neighbours by inner product on a robust-pruned graph.

Identical vectors are one point of the index, which carries the smallest
``k`` + 1 ids that have it: no more of them can be among a query's ``k``.
Points are dealt to shards by the hash of their smallest id.  In each shard a directed
graph is built: greedy searches from an entry point propose neighbours for a
batch of vectors, relaxed-distance pruning keeps diverse edges (an edge to c is
dropped when a kept neighbour p has slack * d(p, c) <= d(v, c)), and reverse
edges are added and pruned likewise.  A beam search then answers every query in
every shard, its finds are scored again in double precision on the original
vectors, and the best ``k`` over all shards are kept.

Largest inner product becomes smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, so norms need not be equal.

Shards hold at most about ``shard_rows`` rows, so an index fits one task;
queries go to a shard in blocks of ``query_rows``.  Every row is indexed; a
shard of at most ``beam`` rows is scanned whole.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of another length than the longest are read
as padded with zeros; rows repeating a vec_id count once; ties go to the
smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.store import written


#: Partitions per shard (or shard and block of queries).  A shard is little data
#: and much work: few bytes must not put several of them into one task.
SPREAD = 4


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>, norm) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    v = v.filter("vec_id is not null and vector is not null").filter(~bad)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("norm", norm).filter("norm > 0")


class Graph:
    """Robust-pruned graph over the rows of ``points`` (float32).

    While it is built a list may hold half as many edges again as ``degree``:
    a reverse edge is appended where there is room, and a full list is pruned
    back to ``degree``, so a row costs a few prunings whatever the shard's size.
    """

    def __init__(self, points: np.ndarray, degree: int, beam: int, slack: float, seed: int):
        self.x = np.ascontiguousarray(points, np.float32)
        self.n = len(points)
        self.degree = min(degree, max(1, self.n - 1))
        self.width = self.degree + self.degree // 2
        self.sq = (self.x * self.x).sum(1)
        mean = self.x.mean(0)
        self.entry = int(np.argmin(((self.x - mean) ** 2).sum(1)))
        self.beam, self.slack = beam, slack
        rng = np.random.default_rng(seed)
        self.links = np.full((self.n, self.width), -1, np.int32)
        self.links[:, : self.degree] = rng.integers(0, self.n, (self.n, self.degree))
        self.links[self.links == np.arange(self.n)[:, None]] = -1

    def build(self, batch: int = 256) -> Graph:
        # the first round only has to make the graph passable
        for round_slack, beam in ((1.0, self.beam // 2), (self.slack, self.beam)):
            order = np.random.default_rng(7).permutation(self.n)
            for i in range(0, self.n, batch):
                rows = order[i : i + batch]
                seen, _ = self.search(self.x[rows], beam)
                cands = np.concatenate([seen, self.links[rows]], 1)
                self._set(rows, self.prune(rows, cands, round_slack))
                self._reverse(rows, round_slack)
        for i in range(0, self.n, 4 * batch):
            rows = np.arange(i, min(i + 4 * batch, self.n))
            rows = rows[(self.links[rows] >= 0).sum(1) > self.degree]
            self._set(rows, self.prune(rows, self.links[rows], self.slack))
        self.links = np.ascontiguousarray(self.links[:, : self.degree])
        return self

    def _set(self, rows: np.ndarray, lists: np.ndarray) -> None:
        self.links[rows, : self.degree] = lists
        self.links[rows, self.degree :] = -1

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances from q [b, d] to points ids [b, m], without |q|^2."""
        return self.sq[ids] - 2 * np.einsum("bd,bmd->bm", q, self.x[ids], optimize=False)

    def search(self, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of a beam search for each row of ``q``; the beam
        ends when all its members are expanded."""
        b = len(q)
        beam = min(beam, self.n)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        ids[:, 0] = self.entry
        dist[:, 0] = self._distance(q, ids[:, :1])[:, 0]
        done[:, 0] = False
        visited = np.zeros((b, self.n + 1), bool)  # the last column takes the blanks
        visited[:, [self.entry, self.n]] = True
        live = np.arange(b)
        while len(live):
            open_dist = np.where(done[live], np.inf, dist[live])
            take = np.argpartition(open_dist, min(expand, beam) - 1, 1)[:, :expand]
            chosen = np.take_along_axis(open_dist, take, 1) < np.inf
            done[live[:, None], take] = True
            from_ids = np.where(chosen, np.take_along_axis(ids[live], take, 1), self.n)
            near = self._neighbours(from_ids)
            near = np.sort(np.where(near < 0, self.n, near), 1)
            fresh = ~visited[live[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            visited[live[:, None], near] = True
            safe = np.where(fresh, near, 0)
            d = np.where(fresh, self._distance(q[live], safe), np.inf).astype(np.float32)
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], 1)
            all_dist = np.concatenate([dist[live], d], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            keep = np.argpartition(all_dist, beam - 1, 1)[:, :beam]
            ids[live] = np.take_along_axis(all_ids, keep, 1)
            dist[live] = np.take_along_axis(all_dist, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1)
            live = live[(~done[live]).any(1)]
        return ids, dist

    def _neighbours(self, ids: np.ndarray) -> np.ndarray:
        got = self.links[np.minimum(ids, self.n - 1)].astype(np.int64)
        got[ids == self.n] = -1
        return got.reshape(len(ids), -1)

    def prune(self, rows: np.ndarray, cands: np.ndarray, slack: float) -> np.ndarray:
        """Diverse neighbours [b, degree] out of candidates [b, c] (-1: blank)."""
        cands = np.sort(cands, 1)
        blank = (cands < 0) | (cands == rows[:, None])
        blank[:, 1:] |= cands[:, 1:] == cands[:, :-1]
        safe = np.where(blank, 0, cands)
        points = self.x[safe]
        own = np.where(blank, np.inf, np.maximum(self._distance(self.x[rows], safe) + self.sq[rows][:, None], 0))
        norms = self.sq[safe]
        out = np.full((len(rows), self.degree), -1, np.int32)
        at = np.arange(len(rows))
        left = own.copy()
        for k in range(self.degree):
            best = np.argmin(left, 1)
            ok = left[at, best] < np.inf
            if not ok.any():
                break
            out[ok, k] = safe[at, best][ok]
            p = points[at, best]
            between = np.maximum(norms + norms[at, best][:, None] - 2 * np.einsum("bd,bmd->bm", p, points), 0)
            left[slack * slack * between <= own] = np.inf
            left[at, best] = np.inf
        return out

    def _reverse(self, rows: np.ndarray, slack: float, most: int = 48) -> None:
        """Add row -> neighbour edges backwards; a list without room for its
        new edges (the nearest ``most`` of them) is pruned."""
        target = self.links[rows].reshape(-1)
        source = np.repeat(rows, self.width)
        ok = target >= 0
        target, source = target[ok], source[ok]
        new = (self.links[target] != source[:, None]).all(1)
        target, source = target[new], source[new]
        if not len(target):
            return
        d = ((self.x[target] - self.x[source]) ** 2).sum(1)
        order = np.lexsort((d, target))
        target, source = target[order], source[order]
        nodes, first = np.unique(target, return_index=True)
        number = np.diff(np.append(first, len(target)))
        place = np.arange(len(target)) - np.repeat(first, number)
        held = self.links[nodes] >= 0
        # blanks lie behind the edges, besides those of the random beginning
        free = np.where(held.any(1), self.width - held[:, ::-1].argmax(1), 0)
        fits = free + number <= self.width
        easy = np.repeat(fits, number)
        self.links[target[easy], np.repeat(free, number)[easy] + place[easy]] = source[easy]
        near = ~easy & (place < most)
        full = nodes[~fits]
        if len(full):
            incoming = np.full((len(full), most), -1, np.int64)
            incoming[np.searchsorted(full, target[near]), place[near]] = source[near]
            self._set(full, self.prune(full, np.concatenate([self.links[full], incoming], 1), slack))


def lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """One more coordinate, so that all norms equal ``largest``."""
    sq = (vectors * vectors).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(largest * largest - sq, 0))[:, None]], 1)


def search_shard(ids: np.ndarray, x: np.ndarray, links: np.ndarray | None, entry: int, q_ids: np.ndarray, q: np.ndarray, k: int, beam: int, largest: float, members: list[np.ndarray] | None = None) -> pd.DataFrame:
    """Best ``k`` rows of one shard for each query, by exact inner product.
    ``members``: the ids that share a point, smallest first."""
    lens = np.ones(len(ids), np.int64) if members is None else np.array([len(m) for m in members], np.int64)
    flat = ids if members is None else np.concatenate(members).astype(np.int64)
    begin = np.cumsum(lens) - lens
    x64 = x.astype(np.float64)
    out = []
    graph = None
    if links is not None:
        graph = Graph.__new__(Graph)
        graph.x = lifted(x64, largest).astype(np.float32)
        graph.n, graph.degree = links.shape
        graph.links, graph.sq, graph.entry = links, (graph.x * graph.x).sum(1), entry
    for i in range(0, len(q), 512):
        qs, who = q[i : i + 512], q_ids[i : i + 512]
        if graph is None:
            found = np.broadcast_to(np.arange(len(x)), (len(qs), len(x)))
        else:
            found, _ = graph.search(np.concatenate([qs, np.zeros((len(qs), 1))], 1).astype(np.float32), beam)
        score = np.where(found < 0, -np.inf, np.einsum("bd,bmd->bm", qs, x64[np.maximum(found, 0)]))
        order = np.lexsort((ids[found], -score), 1)[:, : k + 1]
        best = np.take_along_axis(score, order, 1)
        row, col = np.nonzero(best > -np.inf)
        point = np.take_along_axis(found, order, 1)[row, col]
        # the point at place col (from 0) has col ids before its own, the query's at most among them
        n = np.minimum(lens[point], k + 1 - col)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = pd.DataFrame({"row": np.repeat(row, n), "vec_id": flat[np.repeat(begin[point], n) + nth], "score": np.repeat(best[row, col], n)})
        one = one[one["vec_id"].to_numpy() != who[one["row"].to_numpy()]].sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
        one = one[one.groupby("row").cumcount().to_numpy() < k]
        out.append(pd.DataFrame({"query_id": who[one["row"].to_numpy()], "vec_id": one["vec_id"].to_numpy(), "score": one["score"].to_numpy()}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    degree: int = 28,
    build_beam: int = 48,
    beam: int = 128,
    slack: float = 1.2,
    shards: int = 12,
    shard_rows: int = 20_000,
    query_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as returned by ``usable``."""
    rows = written(vectors.dropDuplicates(["vec_id"]), "ann-rows")
    asked = written(queries.dropDuplicates(["vec_id"]).select("vec_id", "vector"), "ann-queries")
    size = rows.agg(F.max("norm"), F.max(F.size("vector"))).first()
    largest, dim = size[0] or 0.0, max(size[1] or 0, asked.agg(F.max(F.size("vector"))).first()[0] or 0)
    # -0.0 equals 0.0, and shorter vectors are padded
    same = F.transform(F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vector"))), lambda v: v + F.lit(0.0))
    keyed = rows.select("vec_id", same.alias("vector")).withColumn("k1", F.xxhash64(F.lit(1), "vector")).withColumn("k2", F.xxhash64(F.lit(2), "vector"))
    # a limit on row numbers also holds before the shuffle
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    grouped = keyed.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("k1", "k2")
    points = written(
        grouped.agg(F.min("vec_id").alias("vec_id"), F.min_by("vector", "vec_id").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("members")).drop("k1", "k2"),
        "ann-points",
    )
    n = points.count()
    shards = max(shards, math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(asked.count() / query_rows))
    pad = lambda v: np.stack([np.pad(np.asarray(r, np.float64), (0, dim - len(r))) for r in v]) if len(v) else np.zeros((0, dim))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        x = pad(pdf["vector"])
        out = pdf[["shard", "vec_id", "vector", "members"]].copy()
        out["place"] = np.arange(len(pdf))
        out["links"], out["entry"] = None, 0
        if len(pdf) > beam:
            graph = Graph(lifted(x, largest), degree, build_beam, slack, seed=int(pdf["shard"][0])).build()
            out["links"], out["entry"] = [r.tobytes() for r in graph.links], graph.entry
        return out

    shard = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(shards)).cast("int")
    index = written(
        points.select(shard.alias("shard"), "vec_id", "vector", "members")
        .repartition(SPREAD * shards, "shard")
        .groupBy("shard")
        .applyInPandas(build, "shard int, vec_id long, vector array<double>, members array<long>, place int, links binary, entry int"),
        "ann-index",
    )

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        left = left.sort_values("place")
        links = None if left["links"].isna().any() else np.stack([np.frombuffer(r, np.int32) for r in left["links"]])
        return search_shard(left["vec_id"].to_numpy(), pad(left["vector"]), links, int(left["entry"].iloc[0]), right["vec_id"].to_numpy(), pad(right["vector"]), k, beam, largest, list(left["members"]))

    block = F.pmod(F.xxhash64(F.lit(6), "vec_id"), F.lit(blocks)).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    parts = SPREAD * shards * blocks
    left = index.select("*", every_block).repartition(parts, "shard", "block")
    right = asked.select("vec_id", "vector", block.alias("block"), every_shard).repartition(parts, "shard", "block")
    found = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInPandas(answer, "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows (query_id, vec_id) of ``exact`` that ``found`` has."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"]).count()
    return hit / max(1, exact.count())


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 4096) -> DataFrame:
    """Brute force for measuring recall: a broadcast block of queries against
    all vectors.  ``queries`` must be a bounded sample."""
    asked = queries.select("vec_id", "vector").limit(block_rows).collect()
    dim = max([len(r["vector"]) for r in asked], default=0)
    q = np.stack([np.pad(np.array(r["vector"]), (0, dim - len(r["vector"]))) for r in asked]) if asked else np.zeros((0, 0))
    who = np.array([r["vec_id"] for r in asked], np.int64)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ids = pdf["vec_id"].to_numpy()
            x = np.stack([np.pad(np.asarray(v, np.float64)[:dim], (0, max(0, dim - len(v)))) for v in pdf["vector"]])
            yield search_shard(ids, x, None, 0, who, q, k, 0, 0.0)

    found = vectors.select("vec_id", "vector").mapInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
