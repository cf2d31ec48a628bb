"""Tables written to the shared folder, to cut lineage between steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.session import scratch_path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Later steps (and retries after a lost executor) read the files instead of
    running the lineage again.  ``options`` go to the writer.
    """
    return written_at(df, name, **options)[0]


def written_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, so that a loop can drop what it replaced."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``written_at`` that no later step reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_columns(docs: DataFrame, text_col: str, keep: list[str], new: dict[str, str], each: Callable[[pa.RecordBatch, int], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]]) -> DataFrame:
    """``keep`` columns of ``docs`` plus ``new`` ones (name to type) from whole
    texts.  ``each`` gets a batch and the position of its text column, and
    yields slices of the batch with the new columns' values.  Columns go by
    position, so names in ``keep`` may be anything."""
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    at = keep.index(text_col) if text_col in keep else len(keep)
    frame = docs.select(*named, *([] if text_col in keep else [F.col(f"`{text_col}`").alias("text")]))
    names = [f"k{i}" for i in range(len(keep))]
    added = [f"n{i}" for i in range(len(new))]
    found = [F.lit(None).cast(t).alias(n) for n, t in zip(added, new.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in each(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *values], names=[*names, *added])

    return frame.mapInArrow(run, frame.select(*names, *found).schema).toDF(*keep, *new)
