"""Interaction storage jobs: validation, identity, model routing, history
rows, records, users (upsert), example and mapping logs, key checks.

The per-submission flow of the reference (validate → upsert user → score with
both models → route → pick → guidance → log) becomes a handful of narrow
projections over a submissions table plus a few keyed aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions import scoring as S
from moodframe.functions.constants import (
    DEFAULT_NAME,
    DEFAULT_ROLE,
    EMOTIONS,
    KEYWORD_MODEL,
    MIXED_EMOTION_THRESHOLD,
    MODEL_A,
    MODEL_B,
)
from moodframe.functions.text import WS_CLASS, iso_seconds, trim_ws
from moodframe.operators import predict as P
from moodframe.operators.indexing import with_dense_index
from moodframe.operators.partitioning import materialised
from moodframe.operators.skew import missing_keys, skewed_join
from moodframe.sources import layout

SLOT_A, SLOT_B = 0, 1
PRED_FIELDS = ["slot", "emotion", "confidence", "probs", "model", "cleaned_text"]


# ---------------------------------------------------------------------------
# Validation and identity
# ---------------------------------------------------------------------------


def is_blank(col: Column | str) -> Column:
    """NULL, or nothing but (Unicode) whitespace.  ``rlike`` stops at the first
    non-space character, so this does not scan whole texts."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | ~c.rlike(f"[^{WS_CLASS}]")


def _blank(subs: DataFrame) -> Column:
    # a precomputed flag lets Catalyst prune the text column from upstream joins
    return F.col("text_blank") if "text_blank" in subs.columns else is_blank("text")


def valid_submissions(subs: DataFrame) -> DataFrame:
    return subs.filter(~_blank(subs))


def rejected_submissions(subs: DataFrame) -> DataFrame:
    return subs.filter(_blank(subs))


def clean_identity(subs: DataFrame) -> DataFrame:
    """email stripped; name stripped or 'Learner'; role defaults to 'student'."""
    name = F.coalesce(F.nullif(trim_ws("name"), F.lit("")), F.lit(DEFAULT_NAME))
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(DEFAULT_ROLE))
    return subs.withColumn("email", trim_ws("email")).withColumn("name", name).withColumn("role", role)


# ---------------------------------------------------------------------------
# Slot predictions
# ---------------------------------------------------------------------------


def keyword_slot_predictions(scored: DataFrame, key: str) -> DataFrame:
    """Both model slots from one keyword scoring (no trained model loaded):
    slot A named 'BERT Fallback', slot B 'BiLSTM Fallback'."""
    probs = S.probs_from_tenths()
    cleaned = [F.col("cleaned_text")] if "cleaned_text" in scored.columns else []

    def slot(i: int, name: str) -> Column:
        return F.struct(
            F.lit(i).alias("slot"),
            F.col("emotion"),
            F.col("confidence"),
            probs.alias("probs"),
            F.lit(f"{name} Fallback").alias("model"),
            *cleaned,
        )

    return scored.select(key, slot(SLOT_A, MODEL_A).alias("pred_a"), slot(SLOT_B, MODEL_B).alias("pred_b"))


def with_slot_b(slots: DataFrame, scored: DataFrame, key: str, name: str = MODEL_B) -> DataFrame:
    """Slot predictions with slot B taken from a scored table (key, emotion,
    confidence, probs); rows it does not score keep their fallback."""
    b = scored.select(key, F.col("emotion").alias("_e"), F.col("confidence").alias("_c"), F.col("probs").alias("_p"), F.lit(name).alias("_m"))
    old = F.col("pred_b")
    new = F.struct(
        old["slot"].alias("slot"), F.col("_e").alias("emotion"), F.col("_c").alias("confidence"), F.col("_p").alias("probs"),
        F.col("_m").alias("model"), old["cleaned_text"].alias("cleaned_text"),
    )
    return slots.join(b, key, "left").select(key, "pred_a", F.when(F.col("_e").isNull(), old).otherwise(new).alias("pred_b"))


# ---------------------------------------------------------------------------
# History rows (one per visible result)
# ---------------------------------------------------------------------------


def history_rows(
    subs: DataFrame,
    slot_preds: DataFrame | None,
    key: str,
    guidance: DataFrame | None = None,
    threshold: float = MIXED_EMOTION_THRESHOLD,
) -> DataFrame:
    """Valid submissions joined to both slot predictions, routed to the visible
    results, with the selected result's guidance.

    The choice between slots is a per-row expression over the two structs
    (compare picks the higher confidence, slot A on ties), so no grouping or
    second shuffle is needed; only the join to the predictions is keyed.
    Without ``slot_preds`` the submissions carry their predictions themselves.
    Predictions without a cleaned text give rows without one.
    """
    v = clean_identity(valid_submissions(subs))
    j = v if slot_preds is None else v.join(slot_preds, key)
    fields = [f for f in PRED_FIELDS if f in j.schema["pred_a"].dataType.names]
    choice = F.lower(F.col("model_choice"))
    a, b = F.col("pred_a"), F.col("pred_b")
    selected = (
        F.when(choice == "bilstm", b)
        .when(choice == "compare", F.when(b["confidence"] > a["confidence"], b).otherwise(a))
        .otherwise(a)
    )
    visible = (
        F.when(choice == "bilstm", F.array(b))
        .when(choice == "compare", F.array(a, b))
        .otherwise(F.array(a))
    )
    routed = j.select(
        "*",
        selected["emotion"].alias("selected_emotion"),
        selected["confidence"].alias("selected_confidence"),
        selected["model"].alias("selected_model"),
        F.explode_outer(visible).alias("r"),
    ).drop("pred_a", "pred_b")
    flat = routed.select(
        *[c for c in routed.columns if c != "r"],
        *[F.col(f"r.{f}").alias(f if f != "emotion" else "primary_emotion") for f in fields],
    )
    mixed = S.mixed_from_probs("probs", threshold)
    withm = flat.withColumn("mixed", mixed)
    out = withm.select(
        "*",
        F.when(F.size("mixed") > 1, S.mixed_label("mixed")).otherwise(F.col("primary_emotion")).alias("emotion"),
        S.secondary_emotion("mixed").alias("secondary_emotion"),
        F.map_from_arrays(F.array(*[F.lit(e) for e in EMOTIONS]), F.col("probs")).alias("all_scores"),
    ).drop("mixed")
    g = P.attach_guidance(out, "selected_emotion", guidance)
    return g.withColumnRenamed("response", "ai_response")


# ---------------------------------------------------------------------------
# Texts beside the rows that name them
# ---------------------------------------------------------------------------


def numbered_texts(docs: DataFrame) -> DataFrame:
    """``docs`` written once with ``text_id``, a number of each row.  Rows that
    carry the number instead of the text stay narrow through shuffles and
    writes, however many of them share a text."""
    return materialised(docs.withColumn("text_id", F.monotonically_increasing_id()), "numbered-texts")


def with_texts(rows: DataFrame, texts: DataFrame, name: str = "text") -> DataFrame:
    """``rows`` with the text of their ``text_id`` as ``name``: the last step, in
    which each text is moved once, not once a row."""
    # The join widens its rows: partitions by number are not merged by the size of what they read.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = texts.select("text_id", F.col("text").alias(name))
    # Rows of a text lie together, where a written table holds it once.
    near = rows.repartition(n, "text_id").sortWithinPartitions("text_id")
    return near.join(told.repartition(n, "text_id"), "text_id").drop("text_id")


def _text(history: DataFrame, name: str) -> Column:
    return F.col("text").alias(name) if "text" in history.columns else F.col("text_id")


# ---------------------------------------------------------------------------
# Records, examples, mapping
# ---------------------------------------------------------------------------


def build_records(history: DataFrame, start_id: int = 1) -> DataFrame:
    """One record per visible result of a saved submission; record ids are
    dense in (ts, seq, slot) order, starting at ``start_id``.  A history that
    names its texts by number gives records that do (see ``with_texts``)."""
    saved = history.filter(F.col("save"))
    rec = saved.select(
        "ts",
        "seq",
        "slot",
        "email",
        "field",
        _text(history, "input_text"),
        F.col("primary_emotion").alias("predicted_emotion"),
        "secondary_emotion",
        F.col("confidence").alias("confidence_score"),
        F.col("model").alias("model_used"),
        "ai_response",
        "response_type",
        F.to_json("all_scores").alias("emotion_scores"),
        iso_seconds("ts").alias("timestamp"),
        F.lit(True).alias("csv_logged"),
    )
    return with_dense_index(materialised(rec, "records"), ["ts", "seq", "slot"], "record_id", start_id)


def examples_log(history: DataFrame) -> DataFrame:
    """One example row per saved submission (compare logs one row, for the
    selected result): text, lower-case emotion, confidence, response, field,
    timestamp to the second.  As in ``build_records``, the text may be a number."""
    saved = history.filter(F.col("save"))
    first_slot = saved.filter(
        (F.lower("model_choice") != "compare") | (F.col("slot") == SLOT_A)
    )
    return first_slot.select(
        "seq",
        "ts",
        _text(history, "text"),
        F.lower("selected_emotion").alias("emotion"),
        F.col("selected_confidence").alias("confidence"),
        F.col("ai_response").alias("response"),
        "field",
        iso_seconds("ts").alias("timestamp"),
    )


def append_examples(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new)


def mapping_batch(history: DataFrame) -> DataFrame:
    """(emotion, response, ts, seq) of the selected result per saved submission."""
    saved = history.filter(F.col("save"))
    one = saved.filter((F.lower("model_choice") != "compare") | (F.col("slot") == SLOT_A))
    return one.select(F.col("selected_emotion").alias("emotion"), F.col("ai_response").alias("response"), "ts", "seq")


def mapping_insert_if_absent(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Add (emotion, response) for emotions not yet mapped; within the batch
    the first by (ts, seq) wins.  ``min_by`` aggregates partially per
    emotion before the (tiny, 7-key) shuffle."""
    firsts = batch.groupBy("emotion").agg(
        F.min_by("response", F.struct("ts", "seq")).alias("response")
    )
    new = firsts.join(existing.select("emotion"), "emotion", "left_anti")
    return existing.select("emotion", "response").unionByName(new)


# ---------------------------------------------------------------------------
# Users
# ---------------------------------------------------------------------------


def login_log(subs: DataFrame) -> DataFrame:
    """One login per saved, valid submission (the upsert runs before scoring)."""
    v = clean_identity(valid_submissions(subs)).filter(F.col("save"))
    return v.select("email", "name", "role", "ts", "seq")


def users_from_logins(logins: DataFrame) -> DataFrame:
    """Upsert semantics over a login log: the latest name and role win, the
    count is the number of logins, created_at the first login.  All three
    aggregates are partial-aggregatable, so a user with a huge share of
    logins is combined map-side before the shuffle by email."""
    return login_summary(logins).select("email", "last.name", "last.role", "login_count", "created_at")


def login_summary(logins: DataFrame) -> DataFrame:
    """(email, last (ts, seq, name, role), login_count, created_at)."""
    return logins.groupBy("email").agg(
        F.max(F.struct("ts", "seq", "name", "role")).alias("last"),
        F.count(F.lit(1)).alias("login_count"),
        F.min("ts").alias("created_at"),
    )


def merge_login_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("email").agg(
        F.max("last").alias("last"), F.sum("login_count").alias("login_count"), F.min("created_at").alias("created_at")
    )


def upsert_users(prior: DataFrame, logins: DataFrame) -> DataFrame:
    """Apply a batch of logins to a prior users snapshot (full outer join by email)."""
    b = users_from_logins(logins).select(
        "email",
        F.col("name").alias("b_name"),
        F.col("role").alias("b_role"),
        F.col("login_count").alias("b_count"),
        F.col("created_at").alias("b_created"),
    )
    p = prior.select(
        "email",
        F.col("name").alias("p_name"),
        F.col("role").alias("p_role"),
        F.col("login_count").alias("p_count"),
        F.col("created_at").alias("p_created"),
    )
    j = p.join(b, "email", "full_outer")
    return j.select(
        "email",
        F.coalesce("b_name", "p_name").alias("name"),
        F.coalesce("b_role", "p_role").alias("role"),
        (F.coalesce("p_count", F.lit(0)) + F.coalesce("b_count", F.lit(0))).cast("bigint").alias("login_count"),
        F.coalesce("p_created", "b_created").alias("created_at"),
    )


# ---------------------------------------------------------------------------
# Key checks over records and users
# ---------------------------------------------------------------------------


def fk_valid(records: DataFrame, users: DataFrame) -> DataFrame:
    """Records of known users.  Only distinct emails meet the users; the few
    unknown ones are then taken out of the records (null is unknown)."""
    return skewed_join(records.filter(F.col("email").isNotNull()), missing_keys(records, users, "email"), "email", "left_anti")


def fk_violations(records: DataFrame, users: DataFrame) -> DataFrame:
    known = skewed_join(records, missing_keys(records, users, "email"), "email", "left_semi")
    return known.unionByName(records.filter(F.col("email").isNull()))


def cascade_delete(records: DataFrame, deleted_users: DataFrame) -> DataFrame:
    return skewed_join(records, deleted_users.select("email").distinct(), "email", "left_anti")


def user_records(users: DataFrame, records: DataFrame) -> DataFrame:
    """Each user's records, with the user's columns first."""
    met = skewed_join(records, users, "email")
    return met.select(*users.columns, *[c for c in records.columns if c not in users.columns])


RECORD_ORDER = ["timestamp", "record_id"]


def write_records(records: DataFrame, path: str, table: str, buckets: int = layout.BUCKETS) -> DataFrame:
    """The records as a table laid out by user, each user's in order of time:
    reading one user's opens one bucket.  Records that name their texts by
    number are laid out without them: a text lies once beside the layout."""
    return layout.write_bucketed(records, path, table, "email", RECORD_ORDER, buckets)


def fetch_records(records: DataFrame, email: str | None = None, texts: DataFrame | None = None) -> DataFrame:
    """All records, or one user's when ``email`` is truthy, newest first (of a
    table by ``write_records`` only that user's bucket is read and sorted),
    with their texts from ``texts`` where they name them by number."""
    r = records.filter(F.col("email") == F.lit(email)) if email else records
    r = r if texts is None else with_texts(r, texts, "input_text")
    return r.orderBy(F.col("timestamp").desc(), F.col("record_id").desc())


def keyword_history(subs: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """History rows with both slots falling back to the keyword scorer.

    Each distinct text is scored once (``texts`` keyed by ``key``) and joined
    to the submissions, instead of cleaning the same text per event.
    Submissions without text give rows without any text."""
    scored = P.predict_keyword(texts, [key], model_name=KEYWORD_MODEL)
    scored = scored if "text" in subs.columns else scored.drop("cleaned_text")
    return history_rows(subs, keyword_slot_predictions(scored, key), key)


def clear_history(history: DataFrame) -> DataFrame:
    """An empty history with the same schema (write it over the table to clear)."""
    return history.limit(0)
