"""Corpus pipeline: documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``.  All stages but the last return the columns of ``documents``.

1. language: texts whose compression margins are too narrow, or without a
   letter, go.
2. near_duplicates: one document of each group of near copies stays, the one
   with the smallest doc_id (one without an id where the group has no other);
   rows that repeat a doc_id are told apart by their texts, and texts without
   words all stay.
3. personal_data: found spans become marks; ``n_chars`` follows the text.
4. mixing: documents are dropped or repeated so that sources reach their
   target shares.
5. packing: documents are tokenised, cut and packed into sequences.

Empty tables pass through as empty ones; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodframe.llm import langid, mixing, neardup_text, packing, pii
from moodframe.llm.queries import tokenizer_path
from moodframe.llm.store import written
from moodframe.sources.tables import load_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = docs.filter(~langid.held_out("doc_id", 4, 2))
    found = langid.identify(docs, langid.fit_dictionaries(train), names=("__lang", "__score", "__accepted"))
    return found.filter("__accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, vertices = neardup_text.classes(docs)
    chosen = vertices.groupBy("component").agg(F.min_by("doc", F.struct(F.col("low").isNull(), F.col("doc_id").isNull(), "doc_id", "doc")).alias("first"))
    judged = rows.join(vertices.drop("doc_id").join(chosen, "component"), ["k1", "k2", "n_shingles"], "left")
    # the row that stays has the least doc_id of its component and, of several texts with it, the chosen one
    stays = (F.col("n_shingles") == 0) | ((F.col("doc") == F.col("first")) & F.col("doc_id").eqNullSafe(F.col("low")))
    judged = written(judged.select("doc_id", "n_shingles", "k1", "k2", F.coalesce(stays, F.lit(False)).alias("stays")), "pipeline-judged")
    repeated = judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    gone = judged.filter("not stays and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    some = not repeated.isEmpty() or not judged.filter("doc_id is null").isEmpty()
    if not some:
        return docs.join(gone, docs["doc_id"] == gone["__id"], "left_anti")
    once = docs.join(repeated, docs["doc_id"] == repeated["__id"], "left_anti").filter(F.col("doc_id").isNotNull())
    left = once.join(gone, once["doc_id"] == gone["__id"], "left_anti")
    # rows without an id of their own are told apart by their texts' sets
    more = docs.join(repeated.unionByName(spark.createDataFrame([(None,)], "__id long")), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    keyed = neardup_text.with_set_keys(more, names=("__n", "__k1", "__k2"))
    staying = judged.filter("stays").select(F.col("doc_id").alias("__id"), "n_shingles", "k1", "k2").distinct()
    met = keyed.join(
        staying, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__n") == F.col("n_shingles")) & (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left_semi"
    )
    nth = F.row_number().over(Window.partitionBy("doc_id", "__n", "__k1", "__k2").orderBy(F.xxhash64("text"), "text"))
    one = met.filter("__n > 0").withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
    return left.unionByName(one.unionByName(met.filter("__n = 0")).drop("__n", "__k1", "__k2"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact_pii(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


#: Rows that share a key and are numbered in one task.
TOGETHER = 1 << 16


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(docs)
    copies = mixed.groupBy("row").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")).withColumnRenamed("row", "__row").filter("__copies > 0")
    copies = written(copies, "pipeline-copies")
    keyed = docs.withColumn("__row", mixing.row_key(F.col("doc_id"), F.col("source"), F.col("text")))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def repeated(counted: DataFrame) -> DataFrame:
        """Rows that share a key share its copies evenly."""
        own = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("long")
        taken = counted.withColumn("__own", own).filter("__own > 0")
        return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__own")))).select(*columns)

    few = keyed.join(copies.filter(F.col("__rows") <= TOGETHER), "__row")
    out = repeated(few.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy("__row"))))
    if copies.filter(F.col("__rows") > TOGETHER).isEmpty():
        return out
    # very many rows of one key are numbered in parts, by their texts
    part = F.pmod(F.xxhash64("text"), F.ceil(F.col("__rows") / F.lit(TOGETHER)))
    many = keyed.join(copies.filter(F.col("__rows") > TOGETHER), "__row").withColumn("__part", part)
    parts = many.groupBy("__row", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__row").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    placed = many.join(parts.select("__row", "__part", F.coalesce(before, F.lit(0)).alias("__before")), ["__row", "__part"])
    nth = F.col("__before") + F.row_number().over(Window.partitionBy("__row", "__part").orderBy("text"))
    return out.unionByName(repeated(placed.withColumn("__nth", nth)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

#: Compression, MinHash, fitted fields and tokenizers are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
