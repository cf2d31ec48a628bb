"""Golden rows for cleaning and keyword scoring, plus properties."""

import pytest
from pyspark.sql import functions as F

from moodframe.functions import scoring as S
from moodframe.functions import text as T
from moodframe.functions.constants import EMOTIONS
from moodframe.operators import predict as P

# text, cleaned, tenths (label order), emotion, mixed label
GOLDEN = [
    ("Seven boats on grey water", "seven boats on grey water", [2, 2, 2, 2, 2, 2, 2], "Happy", "Happy"),
    ("How curious, a second door", "how curious a second door", [2, 2, 2, 2, 2, 14, 2], "Love", "Love"),
    ("So excited!", "so excited", [14, 2, 2, 2, 2, 2, 2], "Happy", "Happy"),
    ("nervous... then motivated", "nervous then motivated", [14, 2, 2, 14, 2, 2, 2], "Happy", "Happy + Fear"),
    ("I'm UNHAPPY!!! https://x.io/love", "i am unhappy", [32, 14, 2, 2, 2, 2, 2], "Happy", "Happy + Sad"),
    ("Whatever, it's made of glass", "whatever it is made of glass", [2, 2, 26, 2, 2, 2, 2], "Angry", "Angry"),
    ("fear and panic, sad and angry; okay fine", "fear and panic sad and angry okay fine", [2, 32, 32, 44, 2, 2, 26], "Fear", "Fear + Sad + Angry + Neutral"),
    ("happy sad angry fear love neutral wow", "happy sad angry fear love neutral wow", [32, 32, 32, 32, 14, 32, 32], "Happy", "Happy + Sad + Angry + Fear + Love + Neutral"),
    ("I don't like-it, can't enjoy \U0001F600", "i do not likeit cannot enjoy", [14, 2, 2, 2, 2, 26, 2], "Love", "Love + Happy"),
    ("", "", [2] * 7, "Happy", "Happy"),
    ("   ", "", [2] * 7, "Happy", "Happy"),
    ("www.love.com", "", [2] * 7, "Happy", "Happy"),
    ("Surprised by the sudden result, wow", "surprised by the sudden result wow", [2, 2, 2, 2, 38, 2, 2], "Surprise", "Surprise"),
]

CLEAN_ONLY = [
    ("café NAÏVE", "caf na ve"),
    ("go http://x.y tail", "go tail"),
    ("don’t", "don t"),
    ("don't can't won't it's", "do not cannot will not it is"),
    ("shan't I'd've y'all 'tis", "sha not i would have yall notis"),
    ("e.g. well-known,hello", "eg wellknownhello"),
    ("a_b^c~d;e=f", "abcdef"),
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, t) for i, (t, *_rest) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "id int, text string")
    return {r["id"]: r for r in P.with_mixed(P.predict_keyword(df, ["id"], balance=False)).collect()}


def test_golden_cleaning(golden):
    for i, (_t, cleaned, *_r) in enumerate(GOLDEN):
        assert golden[i]["cleaned_text"] == cleaned, GOLDEN[i]


def test_golden_tenths_and_emotion(golden):
    for i, (_t, _c, tenths, emotion, mixed) in enumerate(GOLDEN):
        row = golden[i]
        assert [row[c] for c in S.TENTH_COLS] == tenths, GOLDEN[i]
        assert row["total_tenths"] == sum(tenths)
        assert row["emotion"] == emotion
        assert row["confidence"] == pytest.approx(max(tenths) / sum(tenths), abs=1e-12)
        assert row["mixed_label"] == mixed


def test_clean_only_rows(spark):
    df = spark.createDataFrame([(t,) for t, _ in CLEAN_ONLY], "text string")
    got = [r[0] for r in df.select(T.basic_clean("text")).collect()]
    assert got == [c for _, c in CLEAN_ONLY]


def test_clean_is_idempotent_and_ascii(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    c = d.select(T.basic_clean("text").alias("c"))
    bad = c.filter(~F.col("c").rlike("^[a-z0-9 ]*$") | (T.basic_clean("c") != F.col("c"))).count()
    assert bad == 0


def test_null_text_stays_null(spark):
    df = spark.createDataFrame([(None,)], "text string")
    assert df.select(T.basic_clean("text")).first()[0] is None


def test_tokenize_empty(spark):
    df = spark.createDataFrame([("",), ("a  b",)], "text string")
    got = [r[0] for r in df.select(T.tokenize(T.basic_clean("text"))).collect()]
    assert got == [[], ["a", "b"]]


def test_scores_sum_to_one_and_secondary(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = P.with_mixed(P.with_scores_map(P.predict_keyword(d, ["doc_id"])))
    rows = s.select("scores", "confidence", "secondary_emotion", "mixed").collect()
    for r in rows:
        assert sum(r["scores"].values()) == pytest.approx(1.0, abs=1e-9)
        assert r["confidence"] == pytest.approx(max(r["scores"].values()))
        if len(r["mixed"]) > 1:
            assert r["secondary_emotion"] == r["mixed"][1]["emotion"]
        else:
            assert r["secondary_emotion"] is None


def test_no_python_udf_and_single_clean_in_plan(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = P.mixed_long(P.predict_keyword(d, ["doc_id"]), ["doc_id"]).filter("emotion = 'Sad' and rank = 1")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    assert plan.count("lower(") == 1


def test_cleaning_is_never_in_a_filter(spark):
    """No query's optimised plan tests the cleaning expression in a filter, or
    holds it more than once for each scan of texts."""
    from moodframe.plans.registry import QUERIES

    slow = ("train_", "evaluate_", "training_", "predict_model", "stream_")
    for name, fn in QUERIES.items():
        if name.startswith(slow):
            continue
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Filter" in line.split("(")[0]:
                assert "translate(" not in line, (name, line[:300])
        scans = plan.count("Relation [") + plan.count("RelationV2[")
        assert plan.count("translate(") <= max(1, scans), name


def test_guidance_of_a_caller_is_one_row_an_emotion(spark):
    df = spark.createDataFrame([(1, "Happy"), (2, "Sad"), (3, None)], "id int, emotion string")
    table = spark.createDataFrame([("Happy", "b", "x"), ("Happy", "a", "y"), ("Sad", "c", "z"), ("Sad", "c", "z")], "emotion string, response string, action string")
    got = {r["id"]: (r["response"], r["action"]) for r in P.attach_guidance(df, table=table).collect()}
    assert got == {1: ("a", "y"), 2: ("c", "z"), 3: (None, None)}


def test_guidance_rejects_unknown(spark):
    df = spark.createDataFrame([(1, "Bored")], "id int, emotion string")
    with pytest.raises(Exception):
        P.attach_guidance(df).collect()


def test_mixed_threshold_probs_equals_tenths(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    s = P.predict_keyword(d, ["doc_id"]).persist()
    a = s.select(
        F.transform(S.mixed_array(), lambda x: x["emotion"]).alias("a"),
        F.transform(S.mixed_from_probs(S.probs_from_tenths()), lambda x: x["emotion"]).alias("b"),
    ).collect()
    assert all(r["a"] == r["b"] for r in a)


def test_softmax_and_repair(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0],), ([0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 9.0],)], "p array<double>")
    rows = df.select(S.softmax("p").alias("s"), S.prob_repair("p").alias("r")).collect()
    assert sum(rows[0]["s"]) == pytest.approx(1.0)
    assert rows[1]["r"] == [1.0 / 7] * 7
    assert rows[2]["r"] == pytest.approx([0.5, 0.5, 0, 0, 0, 0, 0])
    assert len(EMOTIONS) == len(rows[0]["r"])
