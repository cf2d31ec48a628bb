"""Selection, vocabulary, encoding, skewed joins, layout, epochs against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodframe.operators import dataset as D
from moodframe.operators import epochs as E
from moodframe.operators import features as FE
from moodframe.operators import lexicon as L
from moodframe.operators import skew
from moodframe.operators import store as ST
from moodframe.operators.indexing import with_dense_index, with_row_numbers
from moodframe.sources import layout

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


# -- split -----------------------------------------------------------------


@pytest.mark.parametrize("few", [1, 64])
def test_split_equals_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(D, "FEW", few)
    rng = random.Random(few)
    rows = [(f"k{i}", rng.choice([0, 0, 0, 1, 4])) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id string, label int")
    got = D.split_stratified(df)
    quota = {r["label"]: r["train_q"] for r in D.split_quotas(df).collect()}
    want = set()
    for label, n in quota.items():
        own = sorted((hashlib.md5(f"42|{k}".encode()).hexdigest(), k) for k, c in rows if c == label)
        want |= {k for _, k in own[:n]}
    assert {r["row_id"] for r in got.filter("split = 'train'").collect()} == want
    plan = executed(got)
    assert "Exchange" not in plan and "Join" not in plan


def test_cuts_at_the_ends(spark):
    h = spark.createDataFrame([(i, 0) for i in range(50)], "row_id int, label int").withColumn("_h", D.split_hash("row_id"))
    order = sorted((hashlib.md5(f"42|{i}".encode()).hexdigest(), i) for i in range(50))
    assert D.split_cuts(h, "row_id", "label", {0: 0}) == {0: None}
    assert D.split_cuts(h, "row_id", "label", {0: 50}) == {0: order[-1]}
    assert D.split_cuts(h, "row_id", None, {0: 7}) == {0: order[6]}


# -- vocabulary and encoding ----------------------------------------------


def plain_vocabulary(rows):
    words, docs, first = Counter(), Counter(), {}
    for key, text in sorted(rows):
        tokens = (text or "").split()
        words.update(tokens)
        docs.update(set(tokens))
        for w in tokens:
            first.setdefault(w, len(first))
    order = sorted(words, key=lambda w: (-words[w], first[w]))
    return {w: (i + 2, words[w], docs[w]) for i, w in enumerate(order)}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vocabulary_equals_plain(spark, kind):
    rng = random.Random(2)
    names = ["w" + "x" * i for i in range(40)]
    rows = [(i if kind == "long" else f"{i:04d}", " ".join(rng.choice(names) for _ in range(rng.randrange(0, 30)))) for i in range(-20 if kind == "long" else 0, 200)]
    df = spark.createDataFrame([*rows, (500 if kind == "long" else "zz", None)], f"row_id {kind}, clean_text string").repartition(5)
    vocab = FE.vocab_fit(df, "row_id")
    assert {r["word"]: (r["index"], r["word_count"], r["doc_count"]) for r in vocab.collect()} == plain_vocabulary(rows)
    stats = FE.word_stats(df, "row_id")
    assert executed(stats).split("== Initial Plan ==")[0].count("hashpartitioning(word") == 1


def test_encoding_needs_no_shuffle(spark):
    df = spark.createDataFrame([(0, "b a b z"), (1, "c a"), (2, ""), (3, None)], "row_id int, clean_text string")
    vocab = spark.createDataFrame([("a", 3), ("b", 2), ("c", 9)], "word string, index int")
    out = FE.encode(df, vocab, "row_id", num_words=9)
    assert {r["row_id"]: r["ids"] for r in out.collect()} == {0: [2, 3, 2, 1], 1: [1, 3], 2: [], 3: []}
    assert {r["row_id"]: r["ids"] for r in FE.encode(df, vocab, "row_id", max_len=2).collect()} == {0: [2, 3], 1: [9, 3], 2: [], 3: []}
    assert "Exchange" not in executed(out)
    assert FE.encode(df.limit(0), vocab.limit(0), "row_id").collect() == []


def test_dense_index(spark):
    rows = [(random.Random(i).randrange(50), i) for i in range(1000)] + [(None, 1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for way in (with_dense_index, with_row_numbers):
        got = {r["b"]: r["n"] for r in way(df, ["a", "b"], "n", 5).collect()}
        assert got == {b: 5 + i for i, (_, b) in enumerate(order)}


# -- lexicon ---------------------------------------------------------------


def test_large_lexicon_equals_brute_force(spark):
    """100,000 keywords of 1 to 12 characters, found by an automaton."""
    import ahocorasick

    rng = random.Random(7)
    texts = [(r["doc_id"], (r["text"] or "").lower()) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).collect()]
    body = " ".join(t for _, t in texts)
    keywords = {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60_000)} | {"e", "th", "q", "the"}
    while len(keywords) < 100_000:
        at, n = rng.randrange(len(body)), rng.randrange(1, 13)
        keywords.add(body[at : at + n])
    keywords = sorted(k for k in keywords if k)
    lexicon = [(rng.choice(["Happy", "Sad"]), k, rng.choice([12, 30])) for k in keywords] + [("Fear", "the", 30)]
    automaton = ahocorasick.Automaton()
    for i, k in enumerate(sorted({k for _, k, _ in lexicon})):
        automaton.add_word(k, k)
    automaton.make_automaton()
    labels = {}
    for e, k, w in lexicon:
        labels.setdefault(k, []).append((e, w))
    want = Counter((d, e, w) for d, t in texts for k in {k for _, k in automaton.iter(t)} for e, w in labels[k])
    df = spark.createDataFrame(texts, "doc_id long, cleaned_text string")
    table = spark.createDataFrame(lexicon, "emotion string, keyword string, weight int").repartition(4)
    got = L.contained(df, ["doc_id"], table)
    assert Counter(map(tuple, got.groupBy("doc_id", "emotion", "weight").count().collect())) == Counter({(*k, n): 1 for k, n in want.items()})


# -- skew and layout -------------------------------------------------------


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, as between large tables."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_user_is_dealt_out(shuffled):
    spark = shuffled
    n = 40_000
    records = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot@x").otherwise(F.concat(F.lit("u"), (F.col("id") % 3000).cast("string"))).alias("email"), F.col("id").alias("record_id"))
    users = records.select("email").distinct().withColumn("name", F.upper("email"))
    plain = records.join(users, "email").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in plain) > n / 2
    met = ST.user_records(users, records)
    sizes = sorted(r["count"] for r in met.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(sizes) == n and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert met.filter("name <> upper(email)").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join_equals_join(spark, how):
    left = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 1), ("c", 2), (None, 3), ("d", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), ("e", 4), (None, 5)], "k string, w int")
    assert skew.heavy_keys(left, "k") == ["a"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(skew.skewed_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_key_checks(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "email string, record_id int")
    users = spark.createDataFrame([("a",), ("c",), ("z",)], "email string")
    ids = lambda df: sorted(r["record_id"] for r in df.collect())
    assert ids(ST.fk_valid(records, users)) == [1, 2, 5]
    assert ids(ST.fk_violations(records, users)) == [3, 4]
    assert ids(ST.cascade_delete(records, users.filter("email = 'a'"))) == [3, 4, 5]


def test_one_users_records_are_one_bucket(spark, tmp_path):
    kinds = "email string, timestamp string, record_id long, text string"
    rows = [(f"u{i % 40}", f"2024-01-{1 + i % 28:02d}", i, "t") for i in range(1000)]
    df = spark.createDataFrame(rows, kinds)
    laid = ST.write_records(df, f"{tmp_path}/records", "records_laid_out", buckets=8)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not show the buckets
    try:
        got = ST.fetch_records(laid, "u7")
        assert "SelectedBucketsCount: 1 out of 8" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    got = ST.fetch_records(laid, "u7")
    want = sorted((r for r in rows if r[0] == "u7"), key=lambda r: (r[1], r[2]), reverse=True)
    assert list(map(tuple, got.collect())) == want
    again = layout.open_bucketed(spark, f"{tmp_path}/records", "records_opened", kinds, "email", ST.RECORD_ORDER, 8)
    assert list(map(tuple, ST.fetch_records(again, "u7").collect())) == want
    for t in ("records_laid_out", "records_opened"):
        spark.sql(f"DROP TABLE {t}")


# -- epochs ----------------------------------------------------------------


def test_epochs_keep_the_best(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        label = i % 3
        ids = [int(x) for x in rng.integers(2, 60, rng.integers(1, 12))] + [60 + label] * int(rng.integers(0, 3))
        rows.append((i, label, (ids + [0] * 16)[:16]))
    df = spark.createDataFrame(rows, "id int, label int, ids array<int>").repartition(4)
    train, held = df.filter("id % 5 > 0").cache(), df.filter("id % 5 = 0").cache()
    model = E.fit(train, held, 3, num_words=64, width=16, epochs=5)
    curve = model.curve(spark).orderBy("epoch").collect()
    assert [r["epoch"] for r in curve] == [1, 2, 3, 4, 5] and sum(r["is_best"] for r in curve) == 1
    best = next(r for r in curve if r["is_best"])
    assert best["validation_loss"] == min(r["validation_loss"] for r in curve)
    x = np.array([r["ids"] for r in held.collect()])
    y = np.array([r["label"] for r in held.collect()])
    p = model.probabilities(x)
    assert -np.log(p[np.arange(len(y)), y]).mean() == pytest.approx(best["validation_loss"])
    assert (p.argmax(1) == y).mean() == pytest.approx(best["validation_accuracy"]) and best["validation_accuracy"] > 0.7
    assert curve[-1]["train_loss"] < curve[0]["train_loss"]
    got = {r["id"]: r["probs"] for r in E.probabilities(model, held, "id", width=16).collect()}
    assert all(np.allclose(got[r["id"]], model.probabilities(np.array([r["ids"]]))[0]) for r in held.collect())
    model.save(spark, str(tmp_path / "m"))
    back = E.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.weights, model.weights) and back.history == model.history


def test_training_step_follows_the_slope():
    """One batch moves each weight against the numeric slope of its loss."""
    rng = np.random.default_rng(4)
    ids = np.array([[2, 3, 0, 0], [3, 3, 4, 0], [5, 0, 0, 0]])
    y = np.array([0, 1, 1])
    w = rng.normal(0, 0.1, (7, 2))

    def loss(w):
        return -np.log(E._softmax(E._evidence(w, ids))[np.arange(3), y]).mean()

    moved, square = w.copy(), np.full_like(w, 1.0)
    E.pass_over(moved, square, ids, y, 1e-3, 0.0)
    for i in range(7):
        for j in range(2):
            d = np.zeros_like(w)
            d[i, j] = 1e-6
            slope = (loss(w + d) - loss(w - d)) / 2e-6
            assert square[i, j] == pytest.approx(1 + slope**2, abs=1e-6)
            assert moved[i, j] == pytest.approx(w[i, j] - 1e-3 * slope / np.sqrt(1 + slope**2), abs=1e-8)


def test_epochs_without_rows(spark):
    none = spark.createDataFrame([], "ids array<int>, label int")
    model = E.fit(none, none, 3, num_words=8, width=4, epochs=3)
    assert model.history == [] and np.allclose(model.probabilities(np.array([[2, 0, 0, 0]])), 1 / 3)
