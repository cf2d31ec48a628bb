"""Language identification by compression.

For each language a raw-content dictionary is cut from training texts; a text
is compressed with every dictionary and belongs to the language that makes it
smallest.  The margin is how much larger the second-smallest is; a text whose
margin is below ``min_margin`` is rejected.

Bounds (documented parameters): a dictionary holds at most ``dict_bytes``
bytes, cut from at most ``sample_rows`` texts and pieces of long texts a
language, chosen by the hash of their row's id and text; every row is classified
on its whole text.  There are as many dictionaries as
language values, and they are broadcast, so ``max_languages`` bounds that (an
error is raised beyond it, nothing is dropped).

Defined results: null text or text without a letter is ``und`` with score 0
and rejected; rows with null lang or null id never train; empty tables give
empty results; without any training row every text is ``und``; ties go to the
first language by name and are rejected (margin 0); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.llm.store import with_columns
from moodframe.llm.words import slices

LETTER = regex.compile(r"\p{L}")
LEVEL = 7
#: A whole text is compressed in parts of so many bytes, so that the dictionary
#: and not the text's own beginning stays what its later parts are matched with.
PART = 2048
#: Texts of at most so many bytes are compressed at a level with shorter
#: matches, where whole bytes would else tie.
SHORT, SHORT_LEVEL = 64, 19
#: Pieces that a long training text gives at most.
PIECES = 8


def held_out(id_col: str, modulus: int, remainder: int):
    """crc32 of the id as text; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus)) == remainder, F.lit(False))


def fit_dictionaries(
    train: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    dict_bytes: int = 96 << 10,
    sample_rows: int = 200,
    max_languages: int = 1000,
) -> dict[str, bytes]:
    """Dictionary bytes by language.

    Counts per language decide a hash threshold that keeps about three times
    ``sample_rows`` rows, so that only a bounded sample meets in the ranking
    window whatever the size of a language.  A dictionary is made of whole
    sampled texts, in hash order, as far as they fit; a text of more than an
    eighth of a dictionary gives pieces of that size at hashed places, the first
    in its turn and up to ``PIECES`` - 1 more after all other texts.
    """
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    if not counts:
        return {}
    keep = F.lit(False)
    # rows that repeat an id are drawn by their texts
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == F.lit(lang)) & (share <= F.lit(3.0 * sample_rows / n)))
    long = F.octet_length("text") > dict_bytes // 8
    count = F.when(long, F.least(F.lit(PIECES), F.floor(F.octet_length("text") / F.lit(dict_bytes // 8)).cast("int"))).otherwise(1)
    cut = rows.filter(keep).withColumn("count", count).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    # a piece lies in its own of ``count`` equal parts; bytes are spread over characters evenly
    part = F.floor(F.char_length("text") / F.col("count")).cast("int")
    size = F.least(part, F.floor(F.lit(dict_bytes // 8) * F.char_length("text") / F.octet_length("text")).cast("int"))
    start = F.col("nth") * part + F.pmod(F.xxhash64("id", "nth"), (part - size + 1).cast("long")).cast("int") + 1
    cut = cut.withColumn("text", F.when(long, F.substring("text", start, size)).otherwise(F.col("text")))
    order = Window.partitionBy("lang").orderBy("nth", F.xxhash64("id"), "id", "text")
    few = cut.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample_rows)
    found: dict[str, bytes] = {}
    for r in few.select("lang", "text").orderBy("lang", "rank").collect():
        more = found.get(r["lang"], b"") + r["text"].lower().encode() + b"\n"
        if len(more) <= dict_bytes:
            found[r["lang"]] = more
    lost = [lang for lang in counts if lang not in found]
    if lost:  # many equal rows of which the draw took none: their text stands for them
        text = F.substring(F.min_by("text", F.xxhash64("text")), 1, dict_bytes // 8)
        for r in rows.filter(F.col("lang").isin(lost)).groupBy("lang").agg(text.alias("text")).collect():  # <= max_languages rows
            found[r["lang"]] = r["text"].lower().encode() + b"\n"
    return found


Coders = list[tuple[str, zstd.ZstdCompressor]]


def classify(texts: list[str | None], long: Coders, short: Coders) -> list[tuple[str, float, bool]]:
    """(language, relative margin in 0..1, whether it was compared) per text."""
    out = []
    for text in texts:
        if not long or text is None or not LETTER.search(text):
            out.append(("und", 0.0, False))
            continue
        raw = b" " + text.lower().encode() + b" "
        coders = short if len(raw) <= SHORT else long
        parts = [raw[i : i + PART] for i in range(0, len(raw), PART)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in coders)
        margin = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        out.append((sizes[0][1], margin, True))
    return out


def compressors(dictionaries: dict[str, bytes], level: int) -> Coders:
    out = []
    for lang, raw in sorted(dictionaries.items()):
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, write_content_size=False)))
    return out


def identify(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text_col: str = "text",
    keep: list[str] | None = None,
    min_margin: float = 0.004,
    names: tuple[str, str, str] = ("lang_pred", "score", "accepted"),
) -> DataFrame:
    """``keep`` columns of ``docs`` plus language, score and acceptance."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    made: list[tuple[Coders, Coders]] = []

    def each(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        if not made:
            made.append((compressors(shared.value, LEVEL), compressors(shared.value, SHORT_LEVEL)))
        for b in slices(batch, at):
            got = classify(b.column(at).to_pylist(), *made[0])
            yield b, [
                pa.array([g[0] for g in got], pa.string()),
                pa.array([g[1] for g in got], pa.float64()),
                pa.array([g[2] and g[1] >= min_margin for g in got], pa.bool_()),
            ]

    return with_columns(docs, text_col, docs.columns if keep is None else keep, dict(zip(names, ("string", "double", "boolean"))), each)
