"""Toxic spans: the field against enumeration, held-out labels, awkward rows."""

import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moodframe.llm import toxicity
from moodframe.llm.queries import QUERIES


def enumerated(evidence, chain):
    """Marginals of one sequence by summing over all taggings."""
    total, toxic = 0.0, np.zeros(len(evidence))
    step = {(0, 0): 0.0, (0, 1): chain[0], (1, 0): chain[1], (1, 1): chain[2]}
    for tags in itertools.product((0, 1), repeat=len(evidence)):
        worth = np.exp(np.dot(evidence, tags) + chain[3] * tags[0] + sum(step[p] for p in zip(tags, tags[1:])))
        total += worth
        toxic += worth * np.array(tags)
    return toxic / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 9, rng.integers(1, 7))
        evidence, chain = rng.normal(0, 2, lengths.sum()), rng.normal(0, 2, 4)
        first = np.zeros(len(evidence), bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        cut = np.split(evidence, np.cumsum(lengths)[:-1])
        assert np.allclose(toxicity.marginals(evidence, first, chain), np.concatenate([enumerated(e, chain) for e in cut]))


def test_gradient_is_that_of_the_likelihood():
    """One step of training moves each parameter as the slope of the enumerated likelihood says."""
    rng = np.random.default_rng(2)
    features = rng.integers(0, 5, (6, 8)).astype(np.uint32)
    tag = np.array([0, 1, 1, 0, 1, 0], bool)
    first = np.array([1, 0, 0, 0, 1, 0], bool)

    def likelihood(w, chain):
        total = 0.0
        for lo, hi in ((0, 4), (4, 6)):
            evidence = w[features[lo:hi]].sum(1)
            step = {(0, 0): 0.0, (0, 1): chain[0], (1, 0): chain[1], (1, 1): chain[2]}
            worth = lambda t: np.dot(evidence, t) + chain[3] * t[0] + sum(step[p] for p in zip(t, t[1:]))
            total += worth(tag[lo:hi].astype(int).tolist()) - np.log(sum(np.exp(worth(t)) for t in itertools.product((0, 1), repeat=hi - lo)))
        return total

    weights, chain = toxicity.train_field(features, tag, first, 1, 1e-9, 0.0)
    start = np.array([-3.0, 0.0, -3.0, -3.0])
    for i in range(5):
        d = np.zeros(5)
        d[i] = 1e-5
        slope = likelihood(d, start) - likelihood(-d, start)
        assert np.sign(weights[i]) == np.sign(round(slope, 12))
    for i in range(4):
        d = np.zeros(4)
        d[i] = 1e-5
        slope = likelihood(np.zeros(5), start + d) - likelihood(np.zeros(5), start - d) - 0.2e-5 * start[i]
        assert np.sign(chain[i] - start[i]) == np.sign(slope)


def test_tokens_and_spans():
    texts = ["Ünd was — it's 12x!", None, "", "  ", "a\nb"]
    tokens = toxicity.Tokens(pa.array(texts))
    want = [(m.start(), m.end()) for t in texts for m in re.finditer(r"[A-Za-z0-9'\u0080-\U0010ffff]+", t or "")]
    chars = [list(re.finditer(r"[A-Za-z0-9'\u0080-\U0010ffff]+", t or "")) for t in texts]
    assert np.diff(tokens.bounds).tolist() == [len(c) for c in chars] and len(tokens.starts) == len(want)
    spans = toxicity._spans(tokens, np.ones(len(want)), 0.5)
    assert spans == [f"{c[0].start()}:{c[-1].end()}" if c else "" for c in chars]


def test_segments_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 1, (1 << toxicity.WIDTH) + 1).astype(np.float32), np.array([-2.0, 0.3, 0.5, -1.0]))
    model.weights[-1] = 0
    column = pa.array([" ".join(rng.choice(["you", "are", "Some", "word", "clown"], n)) for n in (3000, 0, 5, 900)])
    whole = model.tag(toxicity.Tokens(column))
    monkeypatch.setattr(toxicity, "SEGMENT", 700)
    assert np.allclose(model.tag(toxicity.Tokens(column)), whole, atol=1e-9)


def plain_seeds(rows, least_odds, least_z):
    """Words and beginnings that tell apart, from plain sets and counts."""
    n, count = [0, 0], ({}, {})
    for text, label in rows:
        n[label] += 1
        words = {w.encode() for w in re.findall(r"[a-z]+", text)}
        for g in {(0, w) for w in words} | {(k, w[:k]) for w in words for k in toxicity.BEGINNINGS if len(w) > k}:
            count[label][g] = count[label].get(g, 0) + 1
    out = set()
    for g, a in count[1].items():
        b = count[0].get(g, 0)
        odds = np.log((a + 0.5) / (n[1] - a + 0.5)) - np.log((b + 0.5) / (n[0] - b + 0.5))
        if a >= 4 and odds >= least_odds and odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= least_z:
            out.add(g)
    return out


@pytest.fixture(scope="module")
def made(spark):
    """Texts of made words; toxic ones hold an insult or a word of one stem."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioubdglmnrst"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        text, label = [words[int(k)] for k in rng.integers(0, 400, rng.integers(5, 60))], int(i % 6 == 0)
        if label:
            for _ in range(2):
                text.insert(int(rng.integers(0, len(text))), rng.choice(["blockhead", "vexel" + rng.choice(["ta", "ona", "mire", "us"])]))
        rows.append((i, " ".join(text), label))
    return rows


def test_seeds_equal_plain(spark, made):
    rows = spark.createDataFrame(made, "id long, text string, label int").repartition(3)
    n = sum(r[2] for r in made)
    got = toxicity.seeds(rows, (len(made) - n, n), 2.0, 3.0, 1 << 16)
    want = plain_seeds([r[1:] for r in made], 2.0, 3.0)
    assert want >= {(0, b"blockhead"), (5, b"vexel")}
    keys = set()
    for k, w in want:
        tokens = toxicity.Tokens(pa.array([w.decode() + "x" * (k > 0)]))
        keys.add(int(tokens.keys[0 if k == 0 else 1 + toxicity.BEGINNINGS.index(k)][0]))
    assert set(got.tolist()) == keys


def test_unseen_forms_and_awkward_rows(spark, made):
    model = toxicity.fit(spark.createDataFrame(made, "doc_id long, text string, label int"))
    plain = made[1][1]
    rows = [(1, plain), (1, plain), (2, None), (3, ""), (4, " \n!?"), (None, "You blockhead!"), (5, plain + " vexelorum " + plain), (6, "bado lemi " * 60000 + "blockhead"), (7, "x" * 300000)]
    docs = spark.createDataFrame([(*r, 0.5, 3) for r in rows], "doc_id long, text string, score double, predicted int")
    got = toxicity.score(docs, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["predicted"] == 0 and by[5]["predicted"] == 1 and by[None]["predicted"] == 1
    assert by[None]["spans"] == "4:13" and by[6]["spans"].endswith(f"{600000}:{600009}")
    at = len(plain) + 1
    assert by[5]["spans"] == f"{at}:{at + 9}"
    assert {by[i]["spans"] for i in (1, 2, 3, 4, 7)} == {""}
    again = toxicity.fit(spark.createDataFrame(made, "doc_id long, text string, label int").repartition(7))
    assert np.allclose(again.weights, model.weights, atol=1e-4) and np.allclose(again.curve, model.curve, atol=1e-3)


def test_without_labels(spark, made):
    kinds = "doc_id long, text string, label int"
    docs = spark.createDataFrame([(1, "a b", 0)], kinds)
    assert [r["score"] < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs.limit(0))).collect()] == [True]
    ones = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "c", None), (None, "d", 0), (4, "e", 7)], kinds)
    assert [r["score"] > 0.99 for r in toxicity.score(docs, toxicity.fit(ones)).collect()] == [True]
    assert toxicity.score(docs.limit(0), toxicity.fit(ones)).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = QUERIES["op12_toxic_spans"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    met = got.filter("held_out").join(labels, "doc_id")
    right, recall, wrong = met.agg(
        F.avg((F.col("toxic") == F.col("predicted")).cast("double")),
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))),
    ).first()
    assert right >= 0.96 and recall >= 0.85 and wrong <= 0.02
