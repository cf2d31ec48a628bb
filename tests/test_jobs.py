"""Dataset, split, vocabulary, store, streaming and modeling jobs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from moodframe.operators import dataset as D
from moodframe.operators import evaluation as EV
from moodframe.operators import features as FE
from moodframe.operators import store as ST
from moodframe.sources import files as FS
from moodframe.sources import views as V

SF = "/root/testdata/sf0.001"


def test_csv_reader_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="mf-csv-")
    path = os.path.join(d, "data.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('text,emotion,extra\n"line one\nline two, with ""quotes""",happy,x\nNA,Sad,y\nfine text,None,z\n')
    df = FS.read_labelled_csv(spark, path)
    rows = df.collect()
    assert len(rows) == 3
    assert rows[0]["text"] == 'line one\nline two, with "quotes"'
    assert rows[1]["text"] is None and rows[2]["emotion"] is None
    with open(os.path.join(d, "bad.csv"), "w") as f:
        f.write("body,label\nx,y\n")
    with pytest.raises(ValueError, match="emotion, text not there"):
        FS.read_labelled_csv(spark, os.path.join(d, "bad.csv"))
    with pytest.raises(FileNotFoundError):
        FS.read_labelled_csv(spark, os.path.join(d, "absent.csv"))
    assert FS.read_examples(spark, os.path.join(d, "none")).columns == [
        "text", "emotion", "confidence", "response", "field", "timestamp"
    ]


def test_unsupported_labels_only_raise(spark):
    df = spark.createDataFrame([(1, "some text", "Bored")], "row_id int, text string, emotion string")
    with pytest.raises(ValueError):
        D.prepare_dataset(df)


def test_split_properties(spark):
    p = D.prepare_dataset(V.labelled(spark, SF))
    s = D.split_stratified(p)
    n = p.count()
    assert s.count() == n
    assert s.select("row_id").distinct().count() == n
    sizes = {(r["label"], r["split"]): r["n"] for r in s.groupBy("label", "split").count().withColumnRenamed("count", "n").collect()}
    n_val = sum(v for (_, sp), v in sizes.items() if sp == "validation")
    import math

    assert n_val == math.ceil(0.2 * n)
    # deterministic
    again = {r["row_id"]: r["split"] for r in D.split_stratified(p).collect()}
    assert again == {r["row_id"]: r["split"] for r in s.collect()}


def test_unstratified_when_class_has_one_row(spark):
    rows = [(i, f"text number {i}", "Happy") for i in range(9)] + [(9, "lonely text", "Sad")]
    df = spark.createDataFrame(rows, "row_id int, text string, emotion string")
    s = D.split_stratified(D.prepare_dataset(df))
    assert s.filter(F.col("split") == "validation").count() == 2


def test_vocab_and_encoding(spark):
    rows = [(0, "b a b"), (1, "c a"), (2, "")]
    df = spark.createDataFrame(rows, "row_id int, clean_text string")
    v = {r["word"]: r["index"] for r in FE.vocab_fit(df, "row_id").collect()}
    assert v == {"b": 2, "a": 3, "c": 4}
    few = {r["row_id"]: r["ids"] for r in FE.encode(df, FE.vocab_fit(df, "row_id"), "row_id", num_words=4).collect()}
    assert few == {0: [2, 3, 2], 1: [1, 3], 2: []}  # numbered words past the encoder's limit are OOV
    enc = {r["row_id"]: r["ids"] for r in FE.encode(df, FE.vocab_fit(df.filter("row_id = 0"), "row_id"), "row_id").collect()}
    assert enc == {0: [2, 3, 2], 1: [1, 3], 2: []}
    padded = df.select(FE.pad(F.array(F.lit(5), F.lit(6)), 4).alias("p")).first()["p"]
    assert padded == [5, 6, 0, 0]


def test_users_upsert_incremental_equals_batch(spark):
    logins = ST.login_log(V.submissions(spark, SF))
    full = ST.users_from_logins(logins)
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    inc = ST.upsert_users(ST.users_from_logins(logins.filter(F.col("ts") < cut)), logins.filter(F.col("ts") >= cut))
    a = sorted(tuple(r) for r in full.collect())
    b = sorted(tuple(r) for r in inc.collect())
    assert a == b
    saved = V.submissions(spark, SF).filter("save")
    assert full.agg(F.sum("login_count")).first()[0] == ST.valid_submissions(saved).count()


def test_records_compare_logs_two_records_one_example(spark):
    h = ST.keyword_history(V.submissions(spark, SF), V.texts(spark, SF))
    rec = ST.build_records(h)
    ex = ST.examples_log(h)
    cmp_seq = h.filter((F.lower("model_choice") == "compare") & F.col("save")).select("seq").distinct()
    assert rec.join(cmp_seq, "seq").count() == 2 * cmp_seq.count()
    assert ex.join(cmp_seq, "seq").count() == cmp_seq.count()
    ids = [r[0] for r in rec.select("record_id").orderBy("record_id").collect()]
    assert ids == list(range(1, len(ids) + 1))


def test_confusion_and_metrics(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)], "actual int, predicted int")
    cm = EV.confusion_long(pairs)
    assert cm.count() == 49 and cm.agg(F.sum("n")).first()[0] == 5
    m = EV.weighted_metrics(pairs).first()
    assert m["accuracy"] == pytest.approx(0.6)
    assert m["recall"] == pytest.approx(m["accuracy"])
    ml = EV.mllib_weighted_metrics(pairs)
    assert ml["weightedPrecision"] == pytest.approx(m["precision"])
    assert ml["f1"] == pytest.approx(m["f1"])


def test_metrics_count_labels_outside_the_grid(spark):
    pairs = spark.createDataFrame([(0, 0), (0, -1), (0, None), (9, 9), (1, 9), (None, 1)], "actual int, predicted int")
    m = EV.weighted_metrics(pairs).first()
    assert (m["accuracy"], m["recall"]) == (pytest.approx(0.4), pytest.approx(0.4))
    ml = EV.mllib_weighted_metrics(pairs.na.drop().unionByName(spark.createDataFrame([(0, -7)], "actual int, predicted int")))
    assert ml["weightedPrecision"] == pytest.approx(m["precision"]) and ml["f1"] == pytest.approx(m["f1"])
    report = {r["emotion"]: r for r in EV.classification_report(pairs).collect()}
    assert report["accuracy"]["f1"] == pytest.approx(m["accuracy"])
    assert report["weighted avg"]["precision"] == pytest.approx(m["precision"])
    assert report["weighted avg"]["support"] == 5 and len(report) == 10


def test_evaluation_writer(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "actual int, predicted int")
    EV.write_evaluation(pairs, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/metrics").first()["accuracy"] == pytest.approx(2 / 3)
    assert spark.read.json(f"{tmp_path}/report").count() == 10


def events_in_files(spark, folder, n_files):
    """A copy of the small tables in which events are a folder of files."""
    for name in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(n_files):
        events.filter(F.pmod("event_id", F.lit(n_files)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_streams_of_three_files_equal_batch(spark, tmp_path):
    from moodframe.operators import analytics as A
    from moodframe.streaming import jobs as J

    sf = events_in_files(spark, tmp_path, 3)
    h = ST.keyword_history(V.submissions(spark, sf), V.texts(spark, sf)).persist()
    counts = J.latest_snapshot(spark, J.stream_emotion_counts(spark, sf), "emotion_counts")
    assert rows_of(counts.select("emotion", "count")) == rows_of(A.emotion_counts(h))
    by = J.latest_snapshot(spark, J.stream_field_emotion_model_counts(spark, sf), "field_emotion_model_counts")
    assert rows_of(by.select("field", "emotion", "model", "count")) == rows_of(A.field_emotion_model_counts(h))
    mean = J.mean_confidence(J.latest_snapshot(spark, J.stream_mean_confidence(spark, sf), "mean_confidence")).first()
    kpi = A.history_kpis(h).first()
    assert mean["interactions"] == kpi["interactions"] and mean["avg_confidence"] == pytest.approx(kpi["avg_confidence"])
    assert rows_of(J.users(spark, J.stream_users(spark, sf))) == rows_of(ST.users_from_logins(ST.login_log(V.submissions(spark, sf))))
    recs = J.records(spark, J.stream_records(spark, sf))
    batch = ST.build_records(h)
    assert sorted(r[0] for r in recs.select("record_id").collect()) == list(range(1, batch.count() + 1))
    assert rows_of(recs.select("ts", "seq", "slot", "predicted_emotion")) == rows_of(batch.select("ts", "seq", "slot", "predicted_emotion"))


def test_killed_batch_is_replayed_without_duplicates(spark, tmp_path, monkeypatch):
    """The second batch dies after its rows are written; the restart writes
    them again in the same place."""
    from moodframe.streaming import jobs as J

    sf, out = events_in_files(spark, tmp_path / "in", 3), str(tmp_path / "out")
    batch_of = ST.mapping_batch
    calls = []

    def dies(rows):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("executor lost")
        return batch_of(rows)

    monkeypatch.setattr(ST, "mapping_batch", dies)
    with pytest.raises(Exception, match="executor lost"):
        J.stream_logs(spark, sf, out)
    monkeypatch.setattr(ST, "mapping_batch", batch_of)
    J.stream_logs(spark, sf, out)
    h = ST.keyword_history(V.submissions(spark, sf), V.texts(spark, sf))
    got = J.examples(spark, out)
    assert got.count() == got.select("seq").distinct().count() == ST.examples_log(h).count()
    m = J.mapping(spark, out)
    assert m.count() == m.select("emotion").distinct().count()
    J.stream_logs(spark, sf, out)  # nothing new
    assert J.examples(spark, out).count() == ST.examples_log(h).count()


def good_scorer():
    import numpy as np

    return lambda texts: np.tile([0.1, 0.6, 0.1, 0.05, 0.05, 0.05, 0.05], (len(texts), 1))


def picky_scorer():
    import numpy as np

    def score(texts):
        if any("the" in t for t in texts):
            raise RuntimeError("cannot score this")
        return np.tile([0.1, 0.6, 0.1, 0.05, 0.05, 0.05, 0.05], (len(texts), 1))

    return score


def test_pluggable_scorer_falls_back_per_text():
    """Only the texts that raise fall back, whatever the batch."""
    from moodframe.operators.scorers import probabilities

    texts = ["a b", "on the hill", "c", "", "the"]
    name = f"{__name__}:picky_scorer"
    whole = probabilities(name, texts)
    assert [p is None for p in whole] == [False, True, False, False, True]
    assert whole == [probabilities(name, [t])[0] for t in texts]
    assert probabilities("no_such_module:factory", texts) == [None] * 5 and probabilities(name, []) == []


def test_scored_table_with_fallback(spark):
    from moodframe.operators import modeling as M
    from moodframe.operators import predict as P

    texts = V.texts(spark, SF)
    scored = M.score_with_pandas(texts, "no_such_module:factory", "doc_id", "text")
    out = M.with_fallback(P.predict_keyword(texts, ["doc_id"]), scored, "doc_id", "BERT")
    assert {r[0] for r in out.select("model").distinct().collect()} == {"BERT Fallback"}
    assert {r["model"] for r in M.score_slot(None, texts, "doc_id", "BiLSTM").select("model").distinct().collect()} == {"BiLSTM Fallback"}


def test_model_save_load_roundtrip(spark, tmp_path):
    from moodframe.operators import modeling as M

    p = D.prepare_dataset(V.labelled(spark, SF))
    vocab = FE.vocab_fit(p, "row_id")
    coded = M.as_ids(p, vocab)
    model = M.fit_model_b(coded, coded.limit(0), epochs=2)
    FS.write_model(model, f"{tmp_path}/m")
    FS.write_vocab(vocab, f"{tmp_path}/v")
    args = (V.texts(spark, SF), "doc_id", "BiLSTM")
    a = M.score_slot(model, *args, vocab=vocab).select("doc_id", "emotion", "model").collect()
    b = M.score_slot(FS.read_model(f"{tmp_path}/m"), *args, vocab=FS.read_vocab(spark, f"{tmp_path}/v")).select("doc_id", "emotion", "model").collect()
    assert sorted(a) == sorted(b) and {r["model"] for r in a} == {"BiLSTM"}


def test_stop_words_and_lemmas_are_checked_first(spark):
    df = spark.createDataFrame([(1, "cats sat on the mats")], "row_id int, text string")
    for bad in ([], ["the", " on"], ["the", ""]):
        with pytest.raises(ValueError, match="stop list"):
            D.training_text(df, "row_id", stop_words=bad)
    table = lambda rows: spark.createDataFrame(rows, "surface string, lemma string")
    for rows in ([("cats", "cat"), ("cats", "dog")], [("cats", None)]):
        with pytest.raises(ValueError, match="lemma table"):
            D.training_text(df, "row_id", lemmas=table(rows))
    with pytest.raises(ValueError, match="lacks"):
        D.training_text(df, "row_id", lemmas=table([]).withColumnRenamed("lemma", "base"))
    ok = D.training_text(df, "row_id", lemmas=table([("cats", "cat"), ("cats", "cat"), ("mats", "mat")]))
    assert ok.first()["clean_text"] == "cat sat mat"


def test_lexicon_join_of_any_size(spark):
    """The index by rare grams finds what containment finds."""
    from moodframe.operators.lexicon import keyword_hits, lexicon_table

    texts = spark.createDataFrame([(1, "so happy and unhappy"), (2, ""), (3, "fear of the wow")], "id int, cleaned_text string")
    small = keyword_hits(spark, texts, ["id"], lexicon_table(spark))
    large = keyword_hits(spark, texts, ["id"], lexicon_table(spark), broadcast_keywords=0)
    assert small.count() == 21 and rows_of(small) == rows_of(large)


def test_keyword_scoring_takes_a_lexicon(spark):
    from moodframe.operators import predict as P

    df = spark.createDataFrame([(1, "the river was blue")], "id int, text string")
    assert P.predict_keyword(df, ["id"], lexicon={"Sad": ["blue"]}).first()["emotion"] == "Sad"
    mixed = P.with_mixed(P.predict_keyword(df, ["id"], lexicon={"Sad": ["blue"], "Fear": ["river"]}), threshold=0.05).first()
    assert len(mixed["mixed"]) == 7


def test_shared_folder_is_needed_off_local_masters():
    from types import SimpleNamespace

    from moodframe.session import checkpoint_root

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(SimpleNamespace(sparkContext=context, conf=conf))


def test_scratch_tables_go_with_their_process(tmp_path):
    """A process of its own: nothing of what it wrote is left in the shared folder."""
    import subprocess
    import sys

    code = f"""
import sys; sys.path.insert(0, {os.getcwd()!r})
from moodframe.session import local_session, drop_scratch
from moodframe.operators.partitioning import materialised
s = local_session(1)
assert materialised(s.range(5), "t").count() == 5
drop_scratch(s)
assert materialised(s.range(6), "t").count() == 6
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=120, env=env)
    assert os.listdir(tmp_path)
    assert [f for _, _, files in os.walk(f"{tmp_path}/moodframe") for f in files] == []


def test_writers_and_helpers(spark):
    from moodframe.functions.text import percent
    from moodframe.operators.modeling import model_status

    d = tempfile.mkdtemp(prefix="mf-out-")
    p = D.split_stratified(D.prepare_dataset(V.labelled(spark, SF)))
    FS.write_splits(p.select("row_id", "clean_text", "label", "split"), f"{d}/splits")
    back = spark.read.parquet(f"{d}/splits")
    assert back.count() == p.count()
    assert {r[0] for r in back.select("split").distinct().collect()} == {"train", "validation"}
    FS.write_label_mappings(spark, f"{d}/labels")
    assert FS.read_label_mappings(spark, f"{d}/labels")[:2] == ["Happy", "Sad"]
    assert FS.read_mapping(spark, f"{d}/none").columns == ["emotion", "response"]
    h = ST.keyword_history(V.submissions(spark, SF), V.texts(spark, SF))
    ex = ST.examples_log(h).select("text", "emotion", "confidence", "response", "field", "timestamp")
    FS.write_csv_log(ex, f"{d}/log")
    assert rows_of(FS.read_examples(spark, f"{d}/log")) == rows_of(ex)
    m = ST.mapping_insert_if_absent(FS.read_mapping(spark, f"{d}/none"), ST.mapping_batch(h))
    FS.write_csv_log(m, f"{d}/map")
    assert rows_of(FS.read_mapping(spark, f"{d}/map")) == rows_of(m)
    assert ST.clear_history(h).count() == 0 and ST.clear_history(h).columns == h.columns
    v = FE.vocab_fit(p.filter(F.col("split") == "train"), "row_id")
    FS.write_vocab(v, f"{d}/vocab")
    assert FS.read_vocab(spark, f"{d}/vocab").count() == v.count()
    assert spark.range(1).select(percent(F.lit(0.4567))).first()[0] == "45.7%"
    assert model_status(False, False) == "BiLSTM fallback, BERT fallback"


def test_slot_a_makes_its_features_once(spark, monkeypatch):
    """The fits read a written table of features, without texts; tokens are the
    first words, as a whole split gives them."""
    from pyspark.ml.feature import RegexTokenizer

    from moodframe.operators import modeling as M

    odd = spark.createDataFrame([("  a b\tc\n d ",), ("a b c",), ("a b c d e f",), ("",), (" ",), ("A\u00a0b c",)], "text string")
    whole = RegexTokenizer(inputCol="text", outputCol="w", pattern="\\s+", gaps=True, toLowercase=False).transform(odd)
    want = [r["w"][:3] for r in whole.collect()]
    assert [r["_tokens"] for r in M._tokenizer("text", 3).transform(odd).collect()] == want
    kept = []
    real = M.materialised
    monkeypatch.setattr(M, "materialised", lambda df, name: kept.append(df.columns) or real(df, name))
    rows = [(("good day " if i % 2 else "bad night ") * (1 + i % 5), i % 2) for i in range(60)]
    model = M.fit_model_a(spark.createDataFrame(rows, "text string, label int"), hashed_features=64, max_iter=5)
    assert kept == [["label", "_features"]]
    pairs = M.predictions_for_eval(model, spark.createDataFrame(rows, "text string, label int"), "text")
    assert pairs.filter("actual = predicted").count() == 60


def test_dataset_without_raw_text(spark):
    """Slot B's rows carry no raw text through shuffles and writes."""
    rows = [(i, f"running tests number{i} today", e) for i, e in enumerate(["Happy", " stress ", None, "NA", "Anger"] * 4)]
    df = spark.createDataFrame(rows, "row_id long, text string, emotion string")
    whole, lean = D.prepare_dataset(df, lemmas="corpus", check_nonempty=False), D.prepare_dataset(df, lemmas="corpus", check_nonempty=False, text=False)
    assert "text" not in lean.columns
    assert rows_of(lean) == rows_of(whole.drop("text"))
    read = lean._jdf.queryExecution().optimizedPlan().collectLeaves().mkString(" ")
    assert "tokens" in read and " text#" not in read and "[text#" not in read and ",text#" not in read
