"""Structured Streaming versions of the interaction jobs.

Q1  score submissions as they arrive → records (append, ids continue)
Q2  running users table
Q3  running analytics: interactions per emotion label; per field, emotion and
    model; mean confidence
Q4  example log append + mapping insert-if-absent

The source is the events table, one file or a folder of files.  A submission
that arrives again within the watermark's delay is dropped by its key, so a
replayed file changes nothing.  Documents are a static side, scored once into a
written table before the stream starts; a trigger reads that table alone.  Rows
name their texts by number until they are written.

Results are committed tables (``committed.py``): a batch becomes visible as a
whole, and a replayed batch takes the place of its first attempt.  Users are
keyed state: a streaming aggregation keeps one row per user in the state store
and hands on the users that a batch changed, whose buckets are rewritten.
Checkpoints and outputs live under the shared folder that
``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.operators import predict as P
from moodframe.operators import store as ST
from moodframe.operators.partitioning import materialised, spread
from moodframe.session import scratch_path
from moodframe.sources import views as V
from moodframe.sources.files import is_file
from moodframe.sources.tables import load_table
from moodframe.streaming.committed import Committed

#: How far behind the newest submission one may arrive.  A submission is
#: remembered for as long; one that is later still is dropped as too late, so
#: the delay must cover the disorder of the source's files.
DELAY = "60 days"
#: Folders of the users table: a batch rewrites those of the users it changes.
USER_BUCKETS = 32
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The events table as a file stream.  A folder of part files is streamed
    as it is; a single file through its folder, by name."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    files = spark.readStream.schema(load_table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):
        return files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return files.parquet(path)


def once(events: DataFrame, delay: str = DELAY) -> DataFrame:
    """Each event once, whatever the number of times its file arrives."""
    # a watermark needs an instant, not a wall-clock time
    timed = events.withColumn("_arrived", F.col("ts").cast("timestamp")).withWatermark("_arrived", delay)
    return timed.dropDuplicatesWithinWatermark(["event_id"]).drop("_arrived")


def submissions_stream(spark: SparkSession, sf_dir: str, docs: DataFrame, delay: str = DELAY) -> DataFrame:
    """Submissions of the events stream against the written ``docs``."""
    n_docs = load_table(spark, sf_dir, "documents").count()
    return V.submissions(spark, sf_dir, events=once(events_stream(spark, sf_dir), delay), n_docs=n_docs, docs=docs)


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, text, blank flag and slot predictions of every document in one
    written table."""
    texts = V.documents(spark, sf_dir)
    scored = ST.keyword_slot_predictions(P.predict_keyword(texts, ["doc_id"]).drop("cleaned_text"), "doc_id")
    return ST.numbered_texts(spread(texts).join(scored, "doc_id"))


def history_stream(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """History rows as a stream: events (stream) ⋈ ``docs`` (static, by
    ``scored_documents``), with the numbers of their texts."""
    docs = scored_documents(spark, sf_dir) if docs is None else docs
    return ST.history_rows(submissions_stream(spark, sf_dir, docs.drop("text")), None, "doc_id")


def _run(rows: DataFrame, write: Callable[[DataFrame, int], None], out: str, name: str, mode: str = "append") -> str:
    spark = rows.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        q = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STATE_STORE, before)
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    if q.exception() is not None:
        raise RuntimeError(f"streaming job {name} failed: {q.exception()}")
    return out


def stream_records(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """Q1: append records per micro-batch, with ids dense in (ts, seq, slot)
    order inside each batch.  The next free id is a property of the commit, so
    no history is read."""
    out = out or scratch_path(spark, "records")
    docs = scored_documents(spark, sf_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        table = Committed(batch.sparkSession, out)
        start = table.state(batch_id).properties.get("next_id", 1)
        rows = ST.with_texts(ST.build_records(batch, start), docs, "input_text")
        table.append(rows, batch_id, lambda r: {"next_id": r.agg(F.coalesce(F.max("record_id"), F.lit(start - 1))).first()[0] + 1})

    return _run(history_stream(spark, sf_dir, docs), write, out, "records")


RECORDS = (
    "ts timestamp_ntz, seq long, slot int, email string, field string, input_text string, predicted_emotion string, secondary_emotion string, "
    "confidence_score double, model_used string, ai_response string, response_type string, emotion_scores string, timestamp string, "
    "csv_logged boolean, record_id long"
)
USERS = "email string, last struct<ts: timestamp_ntz, seq: long, name: string, role: string>, login_count long, created_at timestamp_ntz"


def records(spark: SparkSession, out: str) -> DataFrame:
    """Records of the finished batches."""
    return Committed(spark, out).read(RECORDS)


def stream_users(spark: SparkSession, sf_dir: str, out: str | None = None, buckets: int = USER_BUCKETS) -> str:
    """Q2: running users table.  One row per user is held in the state store;
    the rows that a batch changed go into the users' buckets.  (ts, seq) of the
    last login stay in the table, so files may come in any order."""
    out = out or scratch_path(spark, "users")
    docs = materialised(V.documents(spark, sf_dir).select("doc_id", "doc_blank"), "blank-documents")
    users = ST.login_summary(ST.login_log(submissions_stream(spark, sf_dir, docs)))

    def write(batch: DataFrame, batch_id: int) -> None:
        Committed(batch.sparkSession, out).upsert(batch, "email", batch_id, buckets)

    return _run(users, write, out, "users", "update")


def users(spark: SparkSession, out: str) -> DataFrame:
    """Users after the finished batches."""
    return Committed(spark, out).read(USERS).select("email", "last.name", "last.role", "login_count", "created_at")


def _running(rows: DataFrame, out: str, name: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> str:
    """Keep a small running table: each batch's ``partial`` result merged into
    the table of the batch before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = Committed(batch.sparkSession, out)
        now, before = partial(batch), table.state(batch_id)
        if before.folders:
            now = merge(table.read(now.schema, before), now)
        table.replace(now, batch_id)

    return _run(rows, write, out, name)


def _counted(*by: str):
    partial = lambda b: b.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    merge = lambda a, b: a.unionByName(b).groupBy(*by).agg(F.sum("count").alias("count"))
    return partial, merge


def stream_emotion_counts(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """Q3: running interactions per emotion label."""
    return _running(history_stream(spark, sf_dir), out or scratch_path(spark, "emotion_counts"), "emotion_counts", *_counted("emotion"))


def stream_field_emotion_model_counts(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """Q3: running interactions per field, emotion and model."""
    out = out or scratch_path(spark, "field_emotion_model_counts")
    return _running(history_stream(spark, sf_dir), out, "field_emotion_model_counts", *_counted("field", "emotion", "model"))


def stream_mean_confidence(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """Q3: running number of interactions and sum of confidences (their
    quotient is the mean; see ``mean_confidence``)."""
    partial = lambda b: b.agg(F.count("confidence").alias("interactions"), F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence_sum"))
    merge = lambda a, b: a.unionByName(b).agg(F.sum("interactions").alias("interactions"), F.sum("confidence_sum").alias("confidence_sum"))
    return _running(history_stream(spark, sf_dir), out or scratch_path(spark, "mean_confidence"), "mean_confidence", partial, merge)


def mean_confidence(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("interactions", F.try_divide("confidence_sum", "interactions").alias("avg_confidence"))


#: What each running table holds.
RUNNING = {
    "emotion_counts": "emotion string, count long",
    "field_emotion_model_counts": "field string, emotion string, model string, count long",
    "mean_confidence": "interactions long, confidence_sum double",
}


def latest_snapshot(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A running table after the finished batches."""
    return Committed(spark, out).read(RUNNING[name])


EXAMPLES = "seq long, ts timestamp_ntz, text string, emotion string, confidence double, response string, field string, timestamp string"
MAPPING = "emotion string, response string"


def stream_logs(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """Q4: per micro-batch, append the example rows and insert mapping rows
    for emotions that no earlier batch has mapped."""
    out = out or scratch_path(spark, "logs")
    docs = scored_documents(spark, sf_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        rows = materialised(batch, "log-batch")
        Committed(s, f"{out}/examples").append(ST.with_texts(ST.examples_log(rows), docs), batch_id)
        mapping = Committed(s, f"{out}/mapping")
        existing = mapping.read(MAPPING, mapping.state(batch_id))
        merged = ST.mapping_insert_if_absent(existing, ST.mapping_batch(rows))
        mapping.append(merged.join(existing.select("emotion"), "emotion", "left_anti"), batch_id)

    return _run(history_stream(spark, sf_dir, docs), write, out, "logs")


def examples(spark: SparkSession, out: str) -> DataFrame:
    return Committed(spark, f"{out}/examples").read(EXAMPLES)


def mapping(spark: SparkSession, out: str) -> DataFrame:
    return Committed(spark, f"{out}/mapping").read(MAPPING)
