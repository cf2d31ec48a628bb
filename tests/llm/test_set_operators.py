"""Near duplicates, search, packing, mixing, chat: brute force and awkward tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodframe.llm import ann, chat, graph, mixing, neardup_text, neardup_vectors, packing
from moodframe.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reach(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 960)] + [(7, 7)]
    got = {r["vertex"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = reach(sorted({x for e in links if e[0] != e[1] for x in e}), [e for e in links if e[0] != e[1]])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def shingles(text):
    w = WORD.findall(low(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_text(rows):
    sets = {}
    for i, t in rows:
        sets[i] = shingles(t)
    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    common = Counter(p for ids in by.values() for p in itertools.combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    return sets, reach(sorted(sets), links)


def test_near_duplicate_texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        base = list(rng.choice(words, int(rng.integers(30, 300))))
        for _ in range(12):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = "new%d" % rng.integers(0, 10**6)
            rows.append((len(rows) + 10, " ".join(copy)))
    rows += [(1, "One two"), (2, "one TWO "), (3, "two one"), (4, None), (5, ""), (6, " \n\t"), (7, "É b c d e f"), (8, "é b c d e f")]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string").withColumn("component", F.lit("own")).withColumn("sig", F.lit(1))
    got = neardup_text.near_duplicates(docs).collect()
    sets, want = brute_text(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert (r["doc_id"], r["component_id"]) == (r["doc_id"], want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup_text.near_duplicates(docs.limit(0)).collect() == []
    single = neardup_text.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in single if r["n_shingles"]) == [(-1, 3), (3, 3)]


def test_near_duplicate_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, want = brute_text([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = {r["doc_id"]: r["component_id"] for r in neardup_text.near_duplicates(docs).collect()}
    assert got == want


def test_rows_without_an_id_and_ids_with_two_texts(spark):
    """Links run through rows without id; rows that share an id are told apart."""
    rng = np.random.default_rng(15)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))

    def edited(first):  # 110 of 116 shingles stay
        return " ".join(base[:first] + ["new", *base[first + 1 :]])

    far = [*base[:60], *rng.choice(words, 60)]
    rows = [(8, " ".join(base)), (None, edited(30)), (None, edited(90)), (3, edited(60)), (5, " ".join(far)), (5, " ".join(base)), (None, " ".join(far)), (None, "lone words here"), (None, "lone words here"), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in neardup_text.near_duplicates(docs).collect()), key=str)
    want = [(8, True, 3, False), (None, True, 3, False), (None, True, 3, False), (3, True, 3, True), (5, True, 5, True), (5, True, 3, False), (None, True, 5, False),
            (None, True, None, True), (None, True, None, True), (None, False, None, True), (6, False, 6, True)]
    assert got == sorted(want, key=str)


def test_near_copies_below_the_threshold_stay_apart(spark):
    """A group whose members are alike but mostly unlinked: no pair is a row."""
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(2000)]
    base = list(rng.choice(words, 160))
    rows = []
    for i in range(260):
        copy = list(base)
        for k in rng.choice(160, int(rng.choice([1, 5, 6, 7, 8])), replace=False):
            copy[k] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    _, want = brute_text(rows)
    got = {r["doc_id"]: r["component_id"] for r in neardup_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 20 < len(set(want.values())) < 250


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def test_words_that_a_polynomial_hash_confuses(spark):
    from tokenizers import Tokenizer

    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, f"x {one} y z {two} q"), (4, f"x {two} y z {one} q")], "doc_id long, text string")
    assert {r["component_id"] for r in neardup_text.near_duplicates(docs).collect()} == {1, 2, 3, 4}
    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    packed_rows(packing.pack(docs, path).collect(), {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}, 2048)


def test_pruning_rarely_misses():
    """A pair at the threshold falls below a batch's bound about once in 1e4."""
    rng = np.random.default_rng(0)
    hits = np.cumsum(rng.random((20000, neardup_text.HASHES)) < 0.75, 1)
    steps = range(neardup_text.BATCH, neardup_text.HASHES + 1, neardup_text.BATCH)
    lost = np.zeros(len(hits), bool)
    for n in steps:
        lost |= hits[:, n - 1] < neardup_text.fewest_matches(n)
    assert lost.mean() < 0.002


def test_near_duplicate_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 16)).astype(np.float32))]
    for i in range(60):  # copies of a few, nearer and farther, on both sides of the threshold
        base = np.array(rows[i % 5][1])
        rows.append((300 + i, [float(x) for x in (base + rng.standard_normal(16) * 0.05 * (1 + i % 12)).astype(np.float32)]))
    rows += [(400, rows[0][1]), (401, rows[0][1]), (402, None), (403, [0.0] * 16), (404, [float("nan")] * 16), (405, []), (406, [2 * x for x in rows[7][1]])]
    frame = spark.createDataFrame([(i, v, "own") for i, v in rows] + [(407, [None] * 16, "own"), (None, None, "own")], "vec_id long, embedding array<float>, doc string")
    got = neardup_vectors.near_duplicates(frame).collect()
    assert len(got) == len(rows) + 2
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    sim = unit @ unit.T
    np.fill_diagonal(sim, 0)
    ids = [i for i, _ in good]
    want = reach(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(sim >= 0.9)) if a < b])
    n = dict(zip(ids, (sim >= 0.9).sum(1).tolist()))
    for r in got:
        i = r["vec_id"]
        assert (i, r["n_links"], r["component_id"]) == (i, n.get(i, 0), want.get(i, i))
    assert neardup_vectors.near_duplicates(frame.limit(0)).collect() == []


def test_vectors_of_double_precision_and_without_ids(spark):
    """Values beyond single precision, links through rows without an id, one id
    with two vectors, infinities."""
    e = np.eye(6)
    tilt = lambda a, b, c: c * e[a] + math.sqrt(1 - c * c) * e[b]
    mid = tilt(0, 1, 0.93)
    far = 0.93 * mid + math.sqrt(1 - 0.93**2) * (e[1] - (e[1] @ mid) * mid) / np.linalg.norm(e[1] - (e[1] @ mid) * mid)
    rows = [(7, 1e200 * e[0]), (None, 1e-150 * mid), (3, far), (9, e[3]), (9, e[4]), (5, 1e300 * e[4]), (11, [float("inf"), 0, 0, 0, 0, 0]), (12, [float("nan")] * 6), (None, e[5]), (None, e[5])]
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in neardup_vectors.near_duplicates(frame).collect())
    assert far @ e[0] < 0.9 <= far @ mid
    want = [("7", 1, "3", False), ("None", 2, "3", False), ("3", 1, "3", True), ("9", 0, "9", True), ("9", 1, "5", False), ("5", 1, "5", True), ("11", 0, "11", True),
            ("12", 0, "12", True), ("None", 1, "None", True), ("None", 1, "None", True)]
    assert got == sorted(want)


def test_saturated_lists_are_enlarged(spark):
    rows = [(1, k, 0.95 - k / 1000) for k in range(2, 60)] + [(2, k, 0.5 if k > 15 else 0.95) for k in range(20)] + [(3, k, 0.5) for k in range(20)] + [(4, k, 0.99) for k in range(15)]
    lists = neardup_vectors.nearest(spark.createDataFrame(rows, "src long, dst long, sim double"), 0.9)
    assert {r["src"]: len(r["near"]) for r in lists.collect()} == {1: 40, 2: 20, 3: 10, 4: 15}


def test_search_recall(spark):
    vectors = ann.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    asked = vectors.filter("vec_id % 20 = 0")
    found = ann.search(vectors, asked, shards=3)
    exact = ann.exact_neighbours(vectors, asked)
    assert ann.recall(found, exact) >= 0.9
    assert found.count() == exact.count()
    scores = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    for r in found.collect():
        if (r["query_id"], r["vec_id"]) in scores:
            assert r["score"] == pytest.approx(scores[r["query_id"], r["vec_id"]], abs=1e-12)


def test_search_equals_plain_products(spark):
    """Against numpy alone, with repeats, nulls, non-finite values and mixed lengths."""
    rng = np.random.default_rng(21)
    x = rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:1040] = x[20]  # a group of copies of a query
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(9000, None), (9020, [float("nan")] * 24), (9040, [0.0] * 24), (None, [1.0] * 24), (9060, [1.0, 2.0]), (40, [float(a) for a in x[40]])]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = {}
    for r in ann.search(vectors, vectors.filter("vec_id % 20 = 0"), shards=2).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids = np.array([*range(3000), 9060])
    full = np.concatenate([x, [[1.0, 2.0, *[0.0] * 22]]])
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found) == asked
    hits = 0
    for q in asked:
        own = full[3000] if q == 9060 else x[q]
        score = full @ own
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        got = found[q]
        assert sorted(got) == list(range(1, 21))
        assert all(got[k][1] == pytest.approx(score[np.flatnonzero(ids == got[k][0])[0]], abs=1e-12) for k in got)
        assert [(-got[k][1], got[k][0]) for k in range(1, 21)] == sorted((-s, i) for i, s in got.values())
        hits += len({v for v, _ in got.values()} & {int(ids[i]) for i in order})
    assert hits >= 0.95 * 20 * len(asked)


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 3.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    vectors = ann.usable(frame)
    got = ann.search(vectors, vectors.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.search(vectors.limit(0), vectors.limit(0)).collect() == []


def packed_rows(rows, ids_of, seq_len):
    by_seq = defaultdict(list)
    by_doc = defaultdict(Counter)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]][(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])] += 1
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= seq_len
    for doc, got in by_doc.items():
        ids = np.array(ids_of[doc], "<u4")
        for (start, length, crc, n), _ in got.items():
            assert n == len(ids) and zlib.crc32(ids[start : start + length].tobytes()) == crc
        assert sum(k[1] * c for k, c in got.items()) % len(ids) == 0
    return len(by_seq)


def test_packing_documents(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "don't <|endoftext|> É́ “q”,ok"), (-4, "a.b " * 9000), (-4, "a.b " * 9000), (-5, "A\x85b c, d")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("offset", F.lit("own"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    got = packing.pack(docs, path).collect()
    sequences = packed_rows(got, ids, 2048)
    used = sum(r["length"] for r in got)
    assert used == sum(map(len, ids.values())) + len(ids[-4])
    assert used / (sequences * 2048) > 0.97
    assert packing.pack(docs.limit(0), path).collect() == []


def test_patterns_use_up_the_histogram():
    rng = np.random.default_rng(4)
    for top in (1, 3, 50, 2048):
        histogram = Counter(rng.integers(1, top + 1, 5000).tolist())
        used = Counter()
        for lengths, count in packing.plan_patterns(dict(histogram), 2048):
            assert sum(lengths) <= 2048 and count > 0
            for n in lengths:
                used[n] += count
        assert used == histogram


def targets(sizes):
    """Water filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = [s for s in names if s not in fixed]
        share = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] / total > 3 * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | {s: share * weight[s] / total for s in left}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 400)), ["a", "b", "c", None, "tiny"][int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.09, 0.01]))]) for i in range(3000)]
    rows += [(5000, None, "void"), (5001, " \n", "void"), (None, "x y", "a"), (7000, "x y z", "c"), (7000, "x y z", "c")]
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, size double").repartition(3)
    out = mixing.taken(mixing.mix_sources(docs, leaf_rows=128, fan_in=3))
    got = out.collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 400
    again = mixing.taken(mixing.mix_sources(docs.repartition(7), leaf_rows=128, fan_in=3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sources(docs.limit(0)).collect() == []


def test_mixing_keeps_expected_copies():
    """Leaves and tree together round each document by its share."""
    import pandas as pd

    size, share = np.array([9, 7, 6, 5, 4, 3, 2] * 20), 0.37
    runs = []
    for seed in range(1500):
        pdf = pd.DataFrame({"source": "a", "size": size, "row": np.arange(len(size)), "nth": 0, "share": share, "node": 0})
        out = mixing._round_group(pdf, seed, 0).sort_values("row")
        runs.append(out["share"].to_numpy())
    assert np.allclose(np.mean(runs, 0), share, atol=0.06) and abs(np.mean(runs) - share) < 0.005


def test_mixing_deals_out_equal_rows(spark):
    """Rows without an id and of one size are spread over the leaves."""
    n = 100_000
    docs = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.createDataFrame([(i, "w " * 50, "t") for i in range(200)], "doc_id long, text string, source string"))
    base = mixing.counted_rows(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size")).withColumn("row", F.xxhash64("doc_id", "source", "size")))
    made = base.filter("source = 's'").agg(F.count(F.lit(1)), F.countDistinct("nth"), F.max("nth")).first()
    assert tuple(made) == (n, n, n - 1)
    got = mixing.mix_sources(docs, leaf_rows=1024)
    taken = {r["source"]: (r["t"], r["target"], r["n"]) for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()}
    assert taken["s"][2] == n and taken["t"][2] == 200
    assert all(abs(t - target) <= 50 for t, target, _ in taken.values())


def test_pivotal_keeps_expected_copies():
    share, size = np.array([0.2, 0.5, 0.7, 0.35, 0.9]), np.array([50.0, 40.0, 30.0, 20.0, 10.0])
    runs = []
    for seed in range(4000):
        p, held = mixing.pivotal(share, size, np.random.default_rng(seed))
        assert p @ size == pytest.approx(share @ size) and sum(0 < x < 1 for x in p) == (held >= 0)
        runs.append(p)
    assert np.allclose(np.mean(runs, 0), share, atol=0.04)


def test_chat(spark):
    rows = [
        (1, 2, "assistant", "b<|end|>"), (1, 1, "user", "a"), (1, 3, "assistant", "c<\\|next|>"), (1, 4, "user", None), (2, 1, None, "[INST]"),
        (2, 1, None, "[INST]"), (3, 0, "ro<|message|>le", "<\\\\|x|>\n</s><<SYS>>"), (None, 1, "assistant", "lone"), (4, None, "user", "first"), (4, 0, "assistant", ""),
        (5, 0, "assistant", "x" * 50000), (5, 0, "assistant", "tie"), (6, 0, "assistant", "ends with <"), (6, 1, "user", "|> starts"),
    ]
    turns = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    formatted = chat.format_chat(turns)
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    outs = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    assert outs[1] == "<|start|>user<|message|>a<|end|><|start|>assistant<|message|>b<\\|end|><|next|>c<\\\\|next|><|end|><|start|>user<|message|><|end|>"
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns_of in by.items():
        turns_of.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns_of).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns_of if r == "assistant")
        want = (len(turns_of), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(outs[c]))
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) == want
    assert chat.digests(chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_chat_stays_native(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.digests(chat.format_chat(turns))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")


def pair_vectors(n, pairs, seed, dim=64):
    """n random vectors; the first ``pairs`` have a partner at cosine 0.90 to 0.95."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(1)[:, None] * x[:pairs]
    y /= np.linalg.norm(y, axis=1)[:, None]
    c = rng.uniform(0.901, 0.95, pairs)[:, None]
    return np.concatenate([x, c * x[:pairs] + np.sqrt(1 - c * c) * y]).astype(np.float32)


def test_audit_sees_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(6)
    x = pair_vectors(1500, 300, 6)
    hot = x[1499] / np.linalg.norm(x[1499]) + rng.standard_normal((600, 64)) * 0.01
    n = len(x) + len(hot)
    nodes = vector_frame(spark, np.concatenate([x, hot])).select(F.col("vec_id").alias("doc"), "embedding")
    keyed = nodes.select(F.col("doc").alias("row"), F.col("doc").alias("vec_id"), F.col("embedding").alias("vector")).mapInArrow(neardup_vectors._keyed(64, "float32"), "row long, vec_id long, k1 long, k2 long, vec binary")
    nodes = keyed.select(F.col("vec_id").alias("doc"), "vec")
    # the hot group is whole, every second pair is lost
    members = [(i, 1499) for i in [1499, *range(1800, n)]]
    found = [(i, i % 1500) for i in range(1800) if i % 1500 < 300 and i % 2]
    links = spark.createDataFrame(members + found, "vertex long, component long")
    recall, linked, _ = neardup_vectors.audit(nodes, links, n, 64, 0.9)
    assert 0.4 < recall < 0.6 and linked >= 256


def test_orders_grow_until_the_audit_holds(spark, monkeypatch):
    n, pairs = 20000, 1500
    x = pair_vectors(n, pairs, 8)
    x = np.concatenate([x, x[n - 1] / np.linalg.norm(x[n - 1]) + np.random.default_rng(9).standard_normal((600, 64)) * 0.01])
    frame = vector_frame(spark, x).repartition(8)
    got = {r["vec_id"]: r["component_id"] for r in neardup_vectors.near_duplicates(frame).collect()}
    assert sum(got[n + i] == i for i in range(pairs)) >= 0.98 * pairs
    assert all(got[n + pairs + i] == n - 1 for i in range(600))
    needed = [neardup_vectors.orders_needed(10**k, 0.9, 0.99) for k in (3, 5, 7)]
    assert needed == sorted(set(needed))
    # a bound that is reached is an error, not a smaller result
    monkeypatch.setattr(neardup_vectors, "orders_needed", lambda *a: 1)
    with pytest.raises(RuntimeError, match="recall 0"):
        neardup_vectors.near_duplicates(frame, min_rounds=0, max_rounds=0)


def test_search_finds_all_copies(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1200, 32)).astype(np.float32)
    x[100:500] = x[100]  # copies, and rows near them
    x[500:540] = x[100] + rng.standard_normal((40, 32)).astype(np.float32) * 0.05
    x[600:620] = x[600]
    vectors = ann.usable(vector_frame(spark, x))
    asked = vectors.filter("vec_id % 10 = 0")
    found = ann.search(vectors, asked, shards=2)
    exact = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in ann.exact_neighbours(vectors, asked).collect()}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 9)) for r in found.collect()}
    assert len(got) == len(exact) == 120 * 20
    for q in [*range(100, 540, 10), 600, 610]:
        assert [got[q, i] for i in range(1, 21)] == [exact[q, i] for i in range(1, 21)]
