"""Derived input views over the driver's tables.

The reference ships no dataset, so its inputs are derived here from the given
tables (their work grows with the tables):

``texts``        documents(doc_id, text)
``labelled``     texts + a label string per row (synthetic truth, with dirty
                 variants: lower case, padded, unsupported, missing)
``submissions``  one form submission per event, text taken from a document
``chat``         all turns of conversations
``phrases``      all turns, each with one of a few phrases that hold
                 apostrophes, curly quotes, symbols and emoji
``binary``       documents with their quality label

The same definitions are restated in SQL in ``moodframe.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions.constants import ACADEMIC_FIELDS, EMOTIONS, ROLES
from moodframe.functions.text import WS_CLASS
from moodframe.sources.tables import load_table

MODEL_CHOICES = ["bert", "bilstm", "compare"]


def _pick(values: list[str], index: F.Column) -> F.Column:
    """values[index] for a 0-based integer column (broadcast-free literal array)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents").select("doc_id", "text")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, emotion) with a raw label string per document.

    label = EMOTIONS[doc_id % 7]; by doc_id % 11: 1 lower case, 2 padded with a
    space and a tab, 3 unsupported ('Bored'), 4 missing (NULL), 5 the CSV
    null token 'NA'.
    """
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    base = _pick(EMOTIONS, F.pmod("doc_id", F.lit(len(EMOTIONS))))
    k = F.pmod("doc_id", F.lit(11))
    label = (
        F.when(k == 1, F.lower(base))
        .when(k == 2, F.concat(F.lit(" "), base, F.lit("\t")))
        .when(k == 3, F.lit("Bored"))
        .when(k == 4, F.lit(None).cast("string"))
        .when(k == 5, F.lit("NA"))
        .otherwise(base)
    )
    return d.select(F.col("doc_id").alias("row_id"), "text", label.alias("emotion"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, doc_blank): the flag is computed once per document, so
    jobs that only need the flag never carry the text through a shuffle."""
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", "text", (F.col("text").isNull() | ~F.col("text").rlike(f"[^{WS_CLASS}]")).alias("doc_blank"))


def submissions(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, n_docs=None, docs: DataFrame | None = None) -> DataFrame:
    """One submission per event.

    The event is matched to document ``event_id mod count(documents)`` (doc_id
    is dense 0..n-1).  The count is a scalar subquery, so the plan stays lazy
    and the join is an ordinary equi-join on doc_id that Spark can shuffle or
    broadcast by size.  A streaming ``events`` frame can be passed instead of
    the table (then ``n_docs`` is given as a number), and a written table of
    ``documents`` with further columns, which ride along; one without the text
    gives submissions without text.
    """
    ev = (events if events is not None else load_table(spark, sf_dir, "events")).select("event_id", "ts", "user_id")
    docs = documents(spark, sf_dir) if docs is None else docs
    more = [c for c in docs.columns if c not in ("doc_id", "text", "doc_blank")]
    if n_docs is None:
        n_docs = docs.select(F.count(F.lit(1))).scalar()
    else:
        n_docs = F.lit(n_docs)
    e = ev.select(
        "event_id",
        "ts",
        "user_id",
        F.pmod(F.col("event_id"), n_docs).alias("doc_id"),
    )
    j = e.join(docs, "doc_id")
    eid = F.col("event_id")
    name = (
        F.when(F.pmod(eid, F.lit(13)) == 0, F.lit(None).cast("string"))
        .when(F.pmod(eid, F.lit(17)) == 0, F.lit("   "))
        .otherwise(F.concat(F.lit("  User "), F.col("user_id").cast("string")))
    )
    event_blank = F.pmod(eid, F.lit(53)) == 0
    text = [F.when(event_blank, F.lit(" \t ")).otherwise(F.col("text")).alias("text")] if "text" in docs.columns else []
    return j.select(
        F.col("event_id").alias("seq"),
        "ts",
        "doc_id",
        F.concat(F.lit(" user"), F.col("user_id").cast("string"), F.lit("@example.com ")).alias("email"),
        name.alias("name"),
        _pick(ROLES, F.pmod(eid + F.col("user_id"), F.lit(3))).alias("role"),
        _pick(ACADEMIC_FIELDS, F.pmod(eid, F.lit(11))).alias("field"),
        *text,
        (event_blank | F.col("doc_blank")).alias("text_blank"),
        _pick(MODEL_CHOICES, F.pmod(eid, F.lit(3))).alias("model_choice"),
        (F.pmod(eid, F.lit(10)) != 0).alias("save"),
        *more,
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


#: Own phrases: every contraction, both quote forms, symbols, emoji, a URL.
PHRASES = [
    "I can't see why it won't run, but I'm sure it's fine",
    "they\u2019re here, don't worry \U0001F600 okay",
    "we'll go where you'd go; y'all shan't wait",
    "she's GLAD he's back \u2014 we've won!",
    "look at www.example.org/a?b=1 \u2728 isn't it neat",
    "no marks here",
]


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_table(spark, sf_dir, "conversations")
    phrase = _pick(PHRASES, F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(PHRASES))))
    return c.select("conv_id", "turn", F.concat_ws(" ", "text", phrase).alias("text"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = load_table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return d.join(lab, "doc_id")
