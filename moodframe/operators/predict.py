"""Prediction operators: keyword scoring, mixed emotions, ranking, guidance,
model selection and compare, fallback.

All are narrow column expressions over a scored frame except
``select_best`` / ``compare_models`` (grouped by submission) and the guidance
lookup (a broadcast of a fixed 7-row table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.functions import scoring as S
from moodframe.functions.constants import (
    EMOTIONS,
    GUIDANCE,
    KEYWORDS,
    KEYWORD_MODEL,
    MIXED_EMOTION_THRESHOLD,
    RESPONSE_TYPE,
)
from moodframe.functions.text import basic_clean
from moodframe.operators.partitioning import fenced, spread


def score_texts(
    df: DataFrame, keys: list[str], text_col: str = "text", balance: bool = True, lexicon: dict[str, list[str]] = KEYWORDS
) -> DataFrame:
    """keys + cleaned_text + seven tenths + total_tenths.

    Cleaned text and tenths are fenced values: each is evaluated once per row,
    whatever is filtered, joined or read several times above.
    """
    src = spread(df.select(*keys, text_col)) if balance else df.select(*keys, text_col)
    cleaned = src.select(*keys, fenced(basic_clean(text_col)).alias("cleaned_text"))
    tenths = [fenced(S.label_tenths("cleaned_text", e, lexicon)).alias(c) for e, c in zip(EMOTIONS, S.TENTH_COLS)]
    return cleaned.select(*keys, "cleaned_text", *tenths).withColumn("total_tenths", S.total_tenths())


def predict_keyword(
    df: DataFrame,
    keys: list[str],
    text_col: str = "text",
    model_name: str = KEYWORD_MODEL,
    balance: bool = True,
    lexicon: dict[str, list[str]] = KEYWORDS,
) -> DataFrame:
    """Prediction struct in flat form: emotion (first maximum in label order),
    confidence = max / total, plus the tenths for later steps."""
    scored = score_texts(df, keys, text_col, balance, lexicon)
    return scored.select(
        "*",
        F.coalesce(S.argmax_label(), F.lit(S.EMOTIONS[0])).alias("emotion"),
        (S.max_tenths() / F.col("total_tenths").cast("double")).alias("confidence"),
        F.lit(model_name).alias("model"),
    )


def with_scores_map(scored: DataFrame) -> DataFrame:
    return scored.withColumn("scores", S.scores_map())


def with_mixed(scored: DataFrame, threshold: float = MIXED_EMOTION_THRESHOLD) -> DataFrame:
    """Adds ``mixed`` (array of (emotion, tenths)), ``mixed_label`` and
    ``secondary_emotion`` to a frame with tenths and total_tenths."""
    m = scored.withColumn("mixed", S.mixed_array("total_tenths", threshold))
    return m.select(
        "*",
        F.when(F.size("mixed") > 1, S.mixed_label("mixed")).otherwise(F.col("emotion")).alias("mixed_label"),
        S.secondary_emotion("mixed").alias("secondary_emotion"),
    )


def mixed_long(scored: DataFrame, keys: list[str], threshold: float = MIXED_EMOTION_THRESHOLD) -> DataFrame:
    """One row per (text, kept emotion): rank (1-based), emotion, score.

    The ``_outer`` generators are deliberate: the arrays are never empty, and a
    plain ``explode`` makes Catalyst infer a ``size(array) > 0`` filter that it
    pushes below the scoring projections to the scan, copying the whole
    cleaning expression into it (and out of whole-stage codegen).
    """
    m = scored.select(*keys, "total_tenths", S.mixed_array("total_tenths", threshold).alias("mixed"))
    e = m.select(*keys, "total_tenths", F.posexplode_outer("mixed").alias("pos", "m"))
    return e.select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        F.col("m.emotion").alias("emotion"),
        (F.col("m.tenths") / F.col("total_tenths").cast("double")).alias("score"),
    )


def ranked_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """All seven scores per text, sorted descending (label order on ties)."""
    r = scored.select(*keys, "total_tenths", S.sorted_label_array().alias("ranked"))
    e = r.select(*keys, "total_tenths", F.posexplode_outer("ranked").alias("pos", "r"))
    return e.select(
        *keys,
        (F.col("pos") + 1).alias("rank"),
        F.col("r.emotion").alias("emotion"),
        (F.col("r.tenths") / F.col("total_tenths").cast("double")).alias("score"),
    )


def scores_long(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, emotion, label_id, tenths, score) via unpivot of the tenths columns."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("label_id"), F.lit(e).alias("emotion"), F.col(c).alias("tenths"))
            for i, (e, c) in enumerate(zip(EMOTIONS, S.TENTH_COLS))
        ]
    )
    e = scored.select(*keys, "total_tenths", F.explode_outer(pairs).alias("p"))
    return e.select(
        *keys,
        "p.emotion",
        "p.label_id",
        "p.tenths",
        (F.col("p.tenths") / F.col("total_tenths").cast("double")).alias("score"),
    )


def dense_scores(df: DataFrame, keys: list[str], scores_col: str = "scores") -> DataFrame:
    """Every label once per row, in label order, 0.0 where the map lacks it."""
    labels = F.array(*[F.lit(e) for e in EMOTIONS])
    dense = F.transform(
        labels,
        lambda e, i: F.struct(
            i.alias("label_id"), e.alias("emotion"), F.coalesce(F.col(scores_col)[e], F.lit(0.0)).alias("score")
        ),
    )
    return df.select(*keys, F.explode_outer(dense).alias("d")).select(*keys, "d.label_id", "d.emotion", "d.score")


# ---------------------------------------------------------------------------
# Guidance (lookup join against a fixed 7-row table)
# ---------------------------------------------------------------------------


def guidance_table(spark: SparkSession, table: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    rows = [(e, r, a) for e, (r, a) in (table or GUIDANCE).items()]
    return spark.createDataFrame(rows, "emotion string, response string, action string")


def attach_guidance(df: DataFrame, emotion_col: str = "emotion", table: DataFrame | None = None) -> DataFrame:
    """Join the response/action for the predicted emotion.

    The own guidance table has one row per label (seven) and is broadcast; a
    caller's is joined as its size suggests, one row an emotion (the least by
    response, then action).  An unknown label fails the task, as a missing
    dictionary key would.
    """
    if table is None:
        g = F.broadcast(guidance_table(df.sparkSession).withColumnRenamed("emotion", "_g_emotion"))
    else:
        one = table.groupBy(F.col("emotion").alias("_g_emotion")).agg(F.min(F.struct("response", "action")).alias("g"))
        g = one.select("_g_emotion", "g.response", "g.action")
    j = df.join(g, F.col(emotion_col) == F.col("_g_emotion"), "left").drop("_g_emotion")
    checked = F.when(
        F.col("response").isNull() & F.col(emotion_col).isNotNull(),
        F.raise_error(F.concat(F.lit("no guidance for emotion "), F.col(emotion_col))),
    ).otherwise(F.col("response"))
    return j.withColumn("response", checked).withColumn("response_type", F.lit(RESPONSE_TYPE))


# ---------------------------------------------------------------------------
# Model routing, best-of, compare
# ---------------------------------------------------------------------------

SLOT_A, SLOT_B = 0, 1


def route_models(subs: DataFrame) -> DataFrame:
    """Explode a submission into the visible (submission, slot) rows.

    'bilstm' → slot B; 'compare' → both; anything else (default 'bert') → slot A.
    """
    choice = F.lower(F.col("model_choice"))
    slots = (
        F.when(choice == "bilstm", F.array(F.lit(SLOT_B)))
        .when(choice == "compare", F.array(F.lit(SLOT_A), F.lit(SLOT_B)))
        .otherwise(F.array(F.lit(SLOT_A)))
    )
    return subs.withColumn("slot", F.explode(slots))


def select_best(long: DataFrame, keys: list[str], value_cols: list[str]) -> DataFrame:
    """Per submission, the visible result with the highest confidence; ties go
    to the lower slot (model A is listed first).  ``max_by`` is a declarative
    aggregate, so Spark aggregates partially before the shuffle."""
    order = F.struct(F.col("confidence"), (-F.col("slot")).alias("neg_slot"))
    payload = F.struct(*[F.col(c) for c in ["slot", *value_cols]])
    agg = long.groupBy(*keys).agg(F.max_by(payload, order).alias("best"))
    return agg.select(*keys, *[F.col(f"best.{c}").alias(c) for c in ["slot", *value_cols]])


def compare_models(long: DataFrame, keys: list[str], model_key: str = "model_key") -> DataFrame:
    """Nested compare form: per text, map model key → prediction struct."""
    entry = F.struct(F.col(model_key), F.struct("emotion", "confidence", "model").alias("pred"))
    return long.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("results"))
