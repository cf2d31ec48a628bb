"""Packing token sequences by shortest-pack-first over the length histogram.

A document is its token ids followed by one end id.  It is cut into pieces of
``seq_len`` ids and a rest.  Only the histogram of piece lengths (at most
``seq_len`` numbers) meets on the driver: lengths are placed from the longest
down, each into the open packing patterns with the most room left, and the
counts of the patterns are split as they are used up.  The patterns then say
which ranks of each length go to which sequence and offset, and are joined
back to the pieces by (length, rank).

Ids come from a public tokenizer file whose path is a parameter.  A text's ids
are the ids of its words (the tokenizer drops white space, and its rules never
reach across it; a letter followed by ASCII punctuation other than an
apostrophe is a boundary too), so each distinct word is encoded once per
worker and looked up by its bytes afterwards.  Texts that hold a string of the
tokenizer's special tokens are encoded whole.

Defined results: null or empty text is the end id alone; null ids and repeated
rows are separate documents; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.store import written
from moodframe.llm.words import WordTable, cut_at_punctuation, lowered, slices, utf8, word_bounds


class WordIds:
    """Token ids of whole texts; a worker keeps one per tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [s.content.encode().lower() for s in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = WordTable(self.encode)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all words: an id belongs to the word its offset lies in."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in words])
        n = np.bincount(np.searchsorted(ends, [a for a, _ in found.offsets], "right"), minlength=len(words))
        return np.array(found.ids, np.uint32), n

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string column (null: none)."""
        data, offsets = utf8(column)
        starts, ends, _ = cut_at_punctuation(data, *word_bounds(data, offsets))
        raw = data.tobytes()
        out, n = self.table.ids(self.table.rows(lowered(data), starts, ends))
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, offsets)]
        texts = [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        low = raw.lower()
        if any(s in low for s in self.special):
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if any(s in low[a:b] for s in self.special):
                    texts[i] = self.whole(column[i].as_py())
        return texts


_tables: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _tables:
        _tables[path] = WordIds(path)
    return _tables[path]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"


def pieces(docs: DataFrame, tokenizer: str, seq_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of all documents, numbered within their task and length
    (``part``, ``length``, ``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer)
        seen = np.zeros(seq_len + 1, np.int64)
        for batch in batches:
            for b in slices(batch, "text"):
                rows: list[tuple] = []
                part = b.column("part")[0].as_py()
                for doc, ids in zip(b.column("doc_id").to_pylist(), table.ids(b.column("text"))):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), seq_len):
                        piece = ids[start : start + seq_len]
                        rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, int(seen[len(piece)])))
                        seen[len(piece)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
                )

    frame = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("bigint").alias("part"))
    return frame.mapInArrow(run, PIECES)


def plan_patterns(histogram: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences).

    Lengths go from the longest down; each is put into the open patterns with
    the most room first, one piece per sequence and pass, and a pattern whose
    count is larger than the pieces left is split.
    """
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r in room if r >= length), default=None)
            if most is None:
                fit = seq_len // length
                full, rest = divmod(left, fit)
                for n, count in ((fit, full), (rest, 1 if rest else 0)):
                    if count:
                        room.setdefault(seq_len - n * length, []).append(((length,) * n, count))
                break
            pattern, count = room[most].pop()
            if not room[most]:
                del room[most]
            # as many copies as fit into each sequence of this pattern
            fit = min(most // length, max(1, left // count))
            used = min(count, left // fit)
            if used < count:
                room.setdefault(most, []).append((pattern, count - used))
            room.setdefault(most - fit * length, []).append((pattern + (length,) * fit, used))
            left -= used * fit
    return [p for group in room.values() for p in group]


def pack(
    docs: DataFrame,
    tokenizer: str,
    seq_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, seq_len, end_id, id_col, text_col), "pack-pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= seq_len rows

    slots: list[tuple[int, int, int, int, int, int]] = []
    next_rank = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, count in plan_patterns(histogram, seq_len):
        offset = 0
        for length in pattern:
            slots.append((length, next_rank[length], next_rank[length] + count, sequence, offset))
            next_rank[length] += count
            offset += length
        sequence += count
    ranges = spark.createDataFrame(slots or [], "length long, lo long, hi long, sequence long, offset long")
    # Ranges of one length are disjoint and in order: a piece belongs to the
    # last range that begins at or before its rank.
    by_length = ranges.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "sequence", "offset"))).alias("ranges"))
    ranked = cut.join(first.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(by_length), "length")
    at = search(F.col("ranges"), F.col("rank"))
    placed = placed.withColumn("slot", F.element_at("ranges", at))
    return placed.select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("slot")["sequence"] + F.col("rank") - F.col("slot")["lo"]).alias("sequence_id"),
        F.col("slot")["offset"].alias("offset"),
    )


def search(ranges, rank):
    """1-based position of the last range with lo <= rank."""
    return F.greatest(F.lit(1), F.size(F.filter(ranges, lambda r: r["lo"] <= rank))).cast("int")
