"""Tables that micro-batches write, read only as far as they are finished.

    <out>/data/batch_id=N/<attempt>/…   what one attempt at batch N wrote
    <out>/_commits/N                    the table after batch N

A commit names, for every part of the table, the folder that holds it, and
carries a few properties (such as the next free id).  It is written beside and
renamed over its place, so a batch shows as a whole or not at all, and an
attempt that died leaves nothing that a reader sees.  An appended table has a
part for each batch; a keyed one a part for each bucket of its keys, so a batch
rewrites the buckets of the keys that it changes and no others.

A batch starts from the commits before its own number: when it is replayed, its
first attempt does not count.  Folders that the newest commits do not name are
dropped.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.operators.partitioning import materialised

#: Commits (and the folders that they name) kept besides the newest, for
#: readers that began with them.
KEPT = 2


@dataclass
class State:
    """A commit: its batch (-1: none yet), folder of each part, properties."""

    batch_id: int = -1
    folders: dict[str, str] = field(default_factory=dict)
    properties: dict = field(default_factory=dict)


class Committed:
    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.out}/{name}" if name else self.out)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def commits(self) -> list[int]:
        return sorted(int(n) for n in self._names("_commits") if n.isdigit())

    def state(self, before: int | None = None) -> State:
        """The newest commit, or the newest one of a batch under ``before``."""
        found = [n for n in self.commits() if before is None or n < before]
        if not found:
            return State()
        stream = self._fs.open(self._path(f"_commits/{found[-1]}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return State(found[-1], **json.loads(text))

    def new_folder(self, batch_id: int) -> str:
        """Name of a folder for this attempt at a batch."""
        return f"data/batch_id={batch_id}/{uuid.uuid4().hex}"

    def full(self, folder: str) -> str:
        return f"{self.out}/{folder}"

    def commit(self, batch_id: int, changed: dict[str, str], properties: dict | None = None) -> None:
        """Make the ``changed`` parts visible and drop what is no longer named."""
        prior = self.state(batch_id)
        text = json.dumps({"folders": prior.folders | changed, "properties": prior.properties | (properties or {})})
        beside = self._path(f"_commits/_{batch_id}-{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(options, 1)
        over[0] = options.OVERWRITE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self._conf)
        files.rename(files.makeQualified(beside), files.makeQualified(self._path(f"_commits/{batch_id}")), over)
        self._clean()

    def _clean(self) -> None:
        for n in self.commits()[: -1 - KEPT]:
            self._fs.delete(self._path(f"_commits/{n}"), False)
        kept = self.commits()
        named = {f for n in kept for f in self.state(n + 1).folders.values()}
        attempts = {"/".join(f.split("/")[:3]) for f in named}
        for batch in self._names("data"):
            if int(batch.partition("=")[2]) > kept[-1]:
                continue
            for attempt in self._names(f"data/{batch}"):
                folder = f"data/{batch}/{attempt}"
                if folder not in attempts:
                    self._fs.delete(self._path(folder), True)
                else:
                    for part in self._names(folder):
                        if part.startswith("bucket=") and f"{folder}/{part}" not in named:
                            self._fs.delete(self._path(f"{folder}/{part}"), True)

    def read(self, schema, state: State | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of the table (of some ``parts`` of it)."""
        state = state or self.state()
        folders = [f for p, f in state.folders.items() if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.full(f) for f in folders])

    # -- writing -----------------------------------------------------------

    def append(self, rows: DataFrame, batch_id: int, properties=None) -> None:
        """Add a batch's rows; ``properties`` is called with the written rows."""
        folder = self.new_folder(batch_id)
        rows.write.parquet(self.full(folder))
        written = self.spark.read.schema(rows.schema).parquet(self.full(folder))
        self.commit(batch_id, {str(batch_id): folder}, properties(written) if properties else None)

    def replace(self, rows: DataFrame, batch_id: int) -> None:
        """Make ``rows`` the whole table."""
        folder = self.new_folder(batch_id)
        rows.write.parquet(self.full(folder))
        self.commit(batch_id, {"all": folder})

    def upsert(self, changed: DataFrame, key: str, batch_id: int, buckets: int) -> None:
        """Put the ``changed`` rows, one a key, in place of the rows of their
        keys.  Only buckets that hold a changed key are read and written."""
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        fresh = materialised(changed.select("*", bucket), "changed-keys")
        touched = [str(r[0]) for r in fresh.select("bucket").distinct().collect()]  # <= buckets numbers
        if not touched:
            return
        before = self.state(batch_id)
        old = self.read(changed.schema, before, touched).select("*", bucket)
        rows = old.join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)
        folder = self.new_folder(batch_id)
        rows.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(self.full(folder))
        self.commit(batch_id, {b: f"{folder}/bucket={b}" for b in touched})
