"""File sources and sinks: labelled CSV, example / mapping logs, vocabulary,
split output, label mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.constants import CSV_NULL_TOKENS, EMOTIONS

EXAMPLES_SCHEMA = "text string, emotion string, confidence double, response string, field string, timestamp string"
MAPPING_SCHEMA = "emotion string, response string"
REQUIRED = ["text", "emotion"]


def _csv(spark: SparkSession):
    # quoted fields may hold newlines and doubled quotes
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"')


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_labelled_csv(spark: SparkSession, path: str, null_tokens: list[str] = CSV_NULL_TOKENS) -> DataFrame:
    """(text, emotion) as strings (never inferred); CSV null tokens → NULL.

    Raises FileNotFoundError when the path is missing and ValueError naming
    the missing required columns."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no labelled file at {path}")
    df = _csv(spark).csv(path)
    missing = sorted(set(REQUIRED) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: column(s) {', '.join(missing)} not there")
    return df.select(
        *[F.when(F.col(c).isin(null_tokens), F.lit(None).cast("string")).otherwise(F.col(c)).alias(c) for c in REQUIRED]
    )


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log written by the jobs, or an empty frame with the known columns."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return _csv(spark).schema(schema).csv(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, EXAMPLES_SCHEMA)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    return read_log(spark, path, MAPPING_SCHEMA)


def write_csv_log(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Train and validation sets under ``split=train`` / ``split=validation``."""
    w = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def write_label_mappings(spark: SparkSession, path: str) -> None:
    rows = [(i, e) for i, e in enumerate(EMOTIONS)]
    spark.createDataFrame(rows, "id int, emotion string").coalesce(1).write.mode("overwrite").json(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.select("word", "index", "word_count", "doc_count").write.mode("overwrite").parquet(path)


def read_label_mappings(spark: SparkSession, path: str) -> list[str]:
    """Label names in id order, as written by ``write_label_mappings``."""
    rows = spark.read.schema("id int, emotion string").json(path).orderBy("id").collect()  # a row per label
    return [r["emotion"] for r in rows]


def write_model(model, path: str) -> None:
    """A fitted pipeline through MLlib's writer, or a sequence model's tables."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(SparkSession.getActiveSession(), path)


def read_model(path: str):
    from pyspark.ml import PipelineModel

    from moodframe.operators import epochs

    spark = SparkSession.getActiveSession()
    return epochs.load(spark, path) if exists(spark, f"{path}/weights") else PipelineModel.load(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("word", "index", "word_count", "doc_count")
