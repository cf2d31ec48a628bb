"""Committed tables and the streams that write them."""

import pytest
from pyspark.sql import functions as F
from test_jobs import SF, events_in_files, rows_of

from moodframe.operators import store as ST
from moodframe.sources import views as V
from moodframe.streaming import jobs as J
from moodframe.streaming.committed import KEPT, Committed


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each of two partitions is enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def add_events(spark, sf, events):
    events.coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")


def test_batch_with_one_user_rewrites_one_bucket(spark, tmp_path):
    sf, out = events_in_files(spark, tmp_path / "in", 2), str(tmp_path / "out")
    J.stream_users(spark, sf, out, buckets=8)
    before = Committed(spark, out).state()
    assert len(before.folders) > 3 and before.batch_id == 1
    one = spark.read.parquet(f"{SF}/events.parquet").filter("user_id = 7").limit(4)
    add_events(spark, sf, one.withColumn("event_id", F.col("event_id") * 1000 + 1))
    J.stream_users(spark, sf, out, buckets=8)
    after = Committed(spark, out).state()
    changed = [b for b in before.folders if before.folders[b] != after.folders[b]]
    assert after.batch_id > 1 and len(changed) == 1
    assert rows_of(J.users(spark, out)) == rows_of(ST.users_from_logins(ST.login_log(V.submissions(spark, sf))))


def test_readers_see_finished_batches_only(spark, tmp_path, monkeypatch):
    """The second batch dies between writing its rows and its commit."""
    sf, out = events_in_files(spark, tmp_path / "in", 3), str(tmp_path / "out")
    commit = Committed.commit

    def dies(self, batch_id, *args):
        if batch_id == 1:
            raise RuntimeError("driver lost")
        commit(self, batch_id, *args)

    monkeypatch.setattr(Committed, "commit", dies)
    with pytest.raises(Exception, match="driver lost"):
        J.stream_records(spark, sf, out)
    table = Committed(spark, out)
    assert table.state().batch_id == 0 and len(table._names("data")) == 2  # half-written rows lie there
    seen = J.records(spark, out)
    assert seen.count() == table.state().properties["next_id"] - 1
    first = rows_of(seen)
    monkeypatch.setattr(Committed, "commit", commit)
    J.stream_records(spark, sf, out)
    whole = J.records(spark, out)
    assert sorted(r[0] for r in whole.select("record_id").collect()) == list(range(1, whole.count() + 1))
    assert set(first) <= set(rows_of(whole))
    history = ST.keyword_history(V.submissions(spark, sf), V.texts(spark, sf))
    assert whole.count() == ST.build_records(history).count()
    assert len(table._names("data/batch_id=1")) == 1  # the dead attempt is gone


def test_replayed_file_changes_nothing(spark, tmp_path):
    sf = events_in_files(spark, tmp_path / "in", 2)
    records, logs, users = (str(tmp_path / n) for n in ("records", "logs", "users"))
    J.stream_records(spark, sf, records)
    J.stream_logs(spark, sf, logs)
    J.stream_users(spark, sf, users)
    before = [rows_of(x) for x in (J.records(spark, records), J.examples(spark, logs), J.mapping(spark, logs), J.users(spark, users))]
    add_events(spark, sf, spark.read.parquet(f"{SF}/events.parquet").filter("event_id % 2 = 1"))
    J.stream_records(spark, sf, records)
    J.stream_logs(spark, sf, logs)
    J.stream_users(spark, sf, users)
    assert [rows_of(x) for x in (J.records(spark, records), J.examples(spark, logs), J.mapping(spark, logs), J.users(spark, users))] == before


def test_a_late_submission_within_the_delay_counts(spark, tmp_path):
    """Files in any order of time: none of their rows is lost."""
    sf = events_in_files(spark, tmp_path / "in", 1)
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = events.limit(5).withColumn("event_id", F.col("event_id") + 1_000_000).withColumn("ts", F.col("ts") - F.expr("INTERVAL 20 DAYS"))
    add_events(spark, sf, late)
    got = J.records(spark, J.stream_records(spark, sf))
    assert got.count() == ST.build_records(ST.keyword_history(V.submissions(spark, sf), V.texts(spark, sf))).count()


def test_texts_are_named_by_number_until_the_last_step(spark, tmp_path):
    """No written or numbered row carries a text: one shared by many rows lies
    once beside them, and meets them when they are written out."""
    docs = spark.createDataFrame([(0, "so happy today", False), (0, "twice there", False), (1, "I feel stress", False), (2, None, True)], "doc_id long, text string, doc_blank boolean")
    texts = ST.numbered_texts(docs)
    events = spark.createDataFrame([(i, i % 3, 7) for i in range(30)], "event_id long, doc_id long, user_id long")
    subs = events.join(texts.drop("text"), "doc_id").select(
        "doc_id", "text_id", F.col("doc_blank").alias("text_blank"), F.col("event_id").alias("seq"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"),
        F.lit("u@x").alias("email"), F.lit("u").alias("name"), F.lit("student").alias("role"), F.lit("Maths").alias("field"),
        F.lit("compare").alias("model_choice"), F.lit(True).alias("save"),
    )
    one_each = docs.dropDuplicates(["doc_id"])
    h = ST.keyword_history(subs, one_each.select("doc_id", "text"))
    recs, ex = ST.build_records(h), ST.examples_log(h)
    for narrow in (h, recs, ex):
        assert not {"text", "input_text", "cleaned_text"} & set(narrow.columns) and "text_id" in narrow.columns
    # twenty events, ten of them on two texts, each shown by two models
    wide = ST.with_texts(recs, texts, "input_text").groupBy("input_text").count()
    own = dict(map(tuple, wide.collect()))
    assert set(own) == {"so happy today", "twice there", "I feel stress"} and own["I feel stress"] == 20
    assert dict(map(tuple, ST.with_texts(ex, texts).groupBy("text").count().collect())) == dict.fromkeys(own, 10)
    laid = ST.write_records(recs, f"{tmp_path}/narrow", "records_narrow", buckets=2)
    assert "input_text" not in laid.columns
    got = ST.fetch_records(laid, "u@x", texts).select("input_text", "record_id").collect()
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True) and {r[0] for r in got} == set(own)


def test_committed_table(spark, tmp_path):
    table = Committed(spark, str(tmp_path / "t"))
    kinds = "k string, v int"
    frame = lambda rows: spark.createDataFrame(rows, kinds)
    assert table.read(kinds).collect() == [] and table.state().batch_id == -1
    table.upsert(frame([(c, 1) for c in "abcdefgh"]), "k", 0, 4)
    table.upsert(frame([("a", 2), ("z", 2)]), "k", 1, 4)
    table.upsert(frame([]), "k", 2, 4)  # nothing changed, nothing written
    want = sorted([("a", 2), ("z", 2), *[(c, 1) for c in "bcdefgh"]])
    assert sorted(map(tuple, table.read(kinds).collect())) == want and table.state().batch_id == 1
    table.upsert(frame([("a", 2), ("z", 2)]), "k", 1, 4)  # the batch again
    assert sorted(map(tuple, table.read(kinds).collect())) == want
    for i in range(3, 9):
        table.upsert(frame([("a", i)]), "k", i, 4)
    assert len(table.commits()) == 1 + KEPT and dict(table.read(kinds).collect())["a"] == 8
    assert len(table.read(kinds).collect()) == 9
