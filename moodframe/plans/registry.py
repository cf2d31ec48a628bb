"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver's tables (or views Spark derives from them) in
full.  Doubles that are compared with the oracle are rounded to 6 places.
The DuckDB twin of each query is in ``moodframe.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moodframe.functions import scoring as S
from moodframe.functions import text as T
from moodframe.operators import predict as P
from moodframe.session import scratch_path
from moodframe.sources import views as V
from moodframe.sources.tables import load_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(fn: QueryFn) -> QueryFn:
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.predict_keyword(V.texts(spark, sf_dir), ["doc_id"])


# ---------------------------------------------------------------------------
# Text functions
# ---------------------------------------------------------------------------


@query
def q_clean_text(spark, sf_dir):
    from moodframe.operators.partitioning import spread

    d = spread(V.texts(spark, sf_dir))
    return d.select("doc_id", T.basic_clean("text").alias("cleaned_text"))


@query
def q_clean_text_chat(spark, sf_dir):
    c = V.chat(spark, sf_dir)
    return c.select("conv_id", "turn", T.basic_clean("text").alias("cleaned_text"))


@query
def q_expand_contractions(spark, sf_dir):
    c = V.phrases(spark, sf_dir)
    return c.select("conv_id", "turn", T.expand_contractions(F.lower("text")).alias("expanded"))


@query
def q_clean_text_phrases(spark, sf_dir):
    c = V.phrases(spark, sf_dir)
    return c.select("conv_id", "turn", T.basic_clean("text").alias("cleaned_text"))


@query
def q_strip_urls(spark, sf_dir):
    p = load_table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        T.strip_urls(F.lower("url")).alias("url_stripped"),
        T.basic_clean("html").alias("cleaned_html"),
    )


@query
def q_tokenize(spark, sf_dir):
    d = V.texts(spark, sf_dir)
    toks = d.select("doc_id", T.tokenize(T.basic_clean("text")).alias("tokens"))
    return toks.select(
        "doc_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join("tokens", " ").alias("rejoined"),
    )


@query
def q_iso_seconds(spark, sf_dir):
    e = load_table(spark, sf_dir, "events")
    return e.select("event_id", T.iso_seconds("ts").alias("ts_iso"), F.date_format("ts", "HH:mm:ss").alias("time"))


# ---------------------------------------------------------------------------
# Keyword scoring (the core)
# ---------------------------------------------------------------------------


@query
def q_predict_keyword(spark, sf_dir):
    s = scored_docs(spark, sf_dir)
    return s.select(
        "doc_id",
        "emotion",
        r6("confidence").alias("confidence"),
        F.col("total_tenths").cast("bigint").alias("total_tenths"),
        "model",
    )


@query
def q_predict_keyword_chat(spark, sf_dir):
    s = P.predict_keyword(V.chat(spark, sf_dir), ["conv_id", "turn"])
    return s.select("conv_id", "turn", "emotion", r6("confidence").alias("confidence"))


@query
def q_keyword_scores(spark, sf_dir):
    s = P.score_texts(V.texts(spark, sf_dir), ["doc_id"])
    long = P.scores_long(s, ["doc_id"])
    return long.select("doc_id", "emotion", F.col("tenths").cast("bigint").alias("tenths"), r6("score").alias("score"))


@query
def q_emotion_distribution(spark, sf_dir):
    """Flagship: keyword prediction per document, counted by emotion."""
    s = scored_docs(spark, sf_dir)
    return s.groupBy("emotion").agg(
        F.count(F.lit(1)).alias("n_docs"),
        r6(F.avg("confidence")).alias("avg_confidence"),
    )


@query
def q_mixed_emotions(spark, sf_dir):
    s = scored_docs(spark, sf_dir)
    m = P.mixed_long(s, ["doc_id"])
    return m.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "emotion", r6("score").alias("score"))


@query
def q_mixed_label(spark, sf_dir):
    s = P.with_mixed(scored_docs(spark, sf_dir))
    return s.select("doc_id", "emotion", "mixed_label")


@query
def q_secondary_emotion(spark, sf_dir):
    s = P.with_mixed(scored_docs(spark, sf_dir))
    return s.select("doc_id", "secondary_emotion")


@query
def q_ranked_scores(spark, sf_dir):
    s = scored_docs(spark, sf_dir)
    r = P.ranked_scores(s, ["doc_id"])
    return r.select("doc_id", F.col("rank").cast("bigint").alias("rank"), "emotion", r6("score").alias("score"))


@query
def q_dense_scores(spark, sf_dir):
    """Scores of labels without a keyword hit are left out of the maps first:
    the dense form gives them back as 0.0."""
    s = scored_docs(spark, sf_dir)
    hits = F.filter(S.sorted_label_array(), lambda x: x["tenths"] > S.BASE_TENTHS)
    total = F.col("total_tenths").cast("double")
    gaps = F.map_from_entries(F.transform(hits, lambda x: F.struct(x["emotion"], x["tenths"] / total)))
    d = P.dense_scores(s.select("doc_id", gaps.alias("scores")), ["doc_id"])
    return d.select("doc_id", F.col("label_id").cast("bigint").alias("label_id"), "emotion", r6("score").alias("score"))


@query
def q_guidance_join(spark, sf_dir):
    s = scored_docs(spark, sf_dir).select("doc_id", "emotion")
    g = P.attach_guidance(s)
    return g.select("doc_id", "emotion", "response", "action", "response_type")


@query
def q_keyword_hits_join(spark, sf_dir):
    """Lexicon as a table, joined on substring containment: hit count and
    tenths of every document and label."""
    from moodframe.operators.lexicon import keyword_hits
    from moodframe.operators.partitioning import materialised

    cleaned = materialised(scored_docs(spark, sf_dir).select("doc_id", "cleaned_text"), "cleaned")
    hits = keyword_hits(spark, cleaned, ["doc_id"])
    return hits.select("doc_id", "emotion", F.col("n_hits").cast("bigint").alias("n_hits"), F.col("tenths").cast("bigint").alias("tenths"))


# ---------------------------------------------------------------------------
# Submissions → history → records / users / logs
# ---------------------------------------------------------------------------

from moodframe.operators import analytics as A  # noqa: E402
from moodframe.operators import store as ST  # noqa: E402

CUTOFF = "2024-01-16 00:00:00"
# Users known at this point form the snapshot the key checks run against.
SNAPSHOT_CUTOFF = "2024-01-01 06:00:00"
SAMPLE_EMAIL = "user7@example.com"


def history(spark, sf_dir):
    return ST.keyword_history(V.submissions(spark, sf_dir), V.texts(spark, sf_dir))


def history_two_slots(spark, sf_dir):
    """History in which slot B has a model: the external score table."""
    scored = P.predict_keyword(V.texts(spark, sf_dir), ["doc_id"])
    ext = external_scores(spark, sf_dir).filter(F.col("probs").isNotNull()).select(
        "doc_id", S.argmax_from_probs("probs").alias("emotion"), F.array_max("probs").alias("confidence"), "probs"
    )
    slots = ST.with_slot_b(ST.keyword_slot_predictions(scored, "doc_id"), ext, "doc_id")
    return ST.history_rows(V.submissions(spark, sf_dir), slots, "doc_id")


def records_and_texts(spark, sf_dir):
    """(records that name their texts by number, the texts)."""
    from moodframe.operators.partitioning import spread

    docs = ST.numbered_texts(spread(V.documents(spark, sf_dir)))
    subs = V.submissions(spark, sf_dir, docs=docs.drop("text"))
    return ST.build_records(ST.keyword_history(subs, V.texts(spark, sf_dir))), docs


def records(spark, sf_dir):
    return records_and_texts(spark, sf_dir)[0]


def before(df, col="ts"):
    return df.filter(F.col(col) < F.lit(CUTOFF).cast("timestamp_ntz"))


def after(df, col="ts"):
    return df.filter(F.col(col) >= F.lit(CUTOFF).cast("timestamp_ntz"))


@query
def q_submissions_valid(spark, sf_dir):
    v = ST.valid_submissions(V.submissions(spark, sf_dir))
    return v.select("seq", "doc_id", "field", "model_choice", "save")


@query
def q_submissions_rejected(spark, sf_dir):
    r = ST.rejected_submissions(V.submissions(spark, sf_dir))
    return r.select("seq", "doc_id")


@query
def q_submission_identity(spark, sf_dir):
    v = ST.clean_identity(V.submissions(spark, sf_dir))
    return v.select("seq", "email", "name", "role")


@query
def q_route_models(spark, sf_dir):
    r = P.route_models(ST.valid_submissions(V.submissions(spark, sf_dir)))
    return r.select("seq", F.col("slot").cast("bigint").alias("slot"))


@query
def q_history_rows(spark, sf_dir):
    h = history(spark, sf_dir)
    return h.select(
        "seq",
        F.col("slot").cast("bigint").alias("slot"),
        T.iso_seconds("ts").alias("timestamp"),
        "field",
        "emotion",
        "primary_emotion",
        "secondary_emotion",
        r6("confidence").alias("confidence"),
        "ai_response",
        "model",
        "response_type",
    )


@query
def q_select_best_model(spark, sf_dir):
    """Per submission, the result whose guidance is shown."""
    h = history_two_slots(spark, sf_dir)
    best = P.select_best(h, ["seq"], ["primary_emotion", "confidence", "model"])
    return best.select(
        "seq",
        F.col("slot").cast("bigint").alias("slot"),
        F.col("primary_emotion").alias("emotion"),
        r6("confidence").alias("confidence"),
        "model",
    )


@query
def q_compare_models(spark, sf_dir):
    """Compare submissions: nested map per text, flattened back for checking."""
    h = history_two_slots(spark, sf_dir).filter(F.lower("model_choice") == "compare")
    keyed = h.select(
        "seq",
        F.when(F.col("slot") == ST.SLOT_A, F.lit("bert")).otherwise(F.lit("bilstm")).alias("model_key"),
        F.col("primary_emotion").alias("emotion"),
        "confidence",
        "model",
    )
    nested = P.compare_models(keyed, ["seq"])
    flat = nested.select("seq", F.explode("results").alias("model_key", "pred"))
    return flat.select(
        "seq", "model_key", F.col("pred.emotion").alias("emotion"),
        r6("pred.confidence").alias("confidence"), F.col("pred.model").alias("model"),
    )


RECORD_COLS = [
    "record_id", "email", "field", "predicted_emotion", "secondary_emotion", "confidence_score",
    "model_used", "ai_response", "response_type", "timestamp", "csv_logged",
]


def _records_out(r, *more):
    return r.select(*[r6(c).alias(c) if c == "confidence_score" else F.col(c) for c in [*RECORD_COLS, *more]])


@query
def q_records_build(spark, sf_dir):
    return _records_out(ST.with_texts(*records_and_texts(spark, sf_dir), "input_text"), "input_text")


@query
def q_records_all(spark, sf_dir):
    return _records_out(ST.fetch_records(records(spark, sf_dir)))


@query
def q_records_by_user(spark, sf_dir):
    """One user's records, read from the layout by user, with their texts."""
    path = scratch_path(spark, "records-by-user")
    recs, texts = records_and_texts(spark, sf_dir)
    laid = ST.write_records(recs, path, "records_" + path.rsplit("-", 1)[1])
    return _records_out(ST.fetch_records(laid, SAMPLE_EMAIL, texts))


@query
def q_scores_json_roundtrip(spark, sf_dir):
    r = records(spark, sf_dir)
    parsed = r.select("record_id", F.from_json("emotion_scores", "map<string,double>").alias("m"))
    e = parsed.select("record_id", F.explode("m").alias("emotion", "score"))
    return e.select("record_id", "emotion", r6("score").alias("score"))


def _users_out(u):
    return u.select(
        "email", "name", "role", F.col("login_count").cast("bigint").alias("login_count"),
        T.iso_seconds("created_at").alias("created_at"),
    )


@query
def q_users_upsert_batch(spark, sf_dir):
    logins = ST.login_log(V.submissions(spark, sf_dir))
    return _users_out(ST.users_from_logins(logins))


@query
def q_users_upsert_incremental(spark, sf_dir):
    logins = ST.login_log(V.submissions(spark, sf_dir))
    prior = ST.users_from_logins(before(logins))
    return _users_out(ST.upsert_users(prior, after(logins)))


def _examples_out(e):
    return e.select("seq", "emotion", r6("confidence").alias("confidence"), "response", "field", "timestamp")


@query
def q_examples_append(spark, sf_dir):
    ex = ST.examples_log(history(spark, sf_dir))
    return _examples_out(ST.append_examples(before(ex), after(ex)))


@query
def q_examples_count(spark, sf_dir):
    ex = ST.examples_log(history(spark, sf_dir))
    return ex.agg(F.count(F.lit(1)).alias("n_examples"))


@query
def q_mapping_insert_if_absent(spark, sf_dir):
    batch = ST.mapping_batch(history(spark, sf_dir))
    empty = spark.createDataFrame([], "emotion string, response string")
    first = ST.mapping_insert_if_absent(empty, before(batch))
    return ST.mapping_insert_if_absent(first, after(batch))


def _users_snapshot(spark, sf_dir):
    logins = ST.login_log(V.submissions(spark, sf_dir))
    return ST.users_from_logins(logins.filter(F.col("ts") < F.lit(SNAPSHOT_CUTOFF).cast("timestamp_ntz")))


@query
def q_fk_valid(spark, sf_dir):
    return ST.fk_valid(records(spark, sf_dir), _users_snapshot(spark, sf_dir)).select("record_id", "email")


@query
def q_fk_violations(spark, sf_dir):
    return ST.fk_violations(records(spark, sf_dir), _users_snapshot(spark, sf_dir)).select("record_id", "email")


@query
def q_cascade_delete(spark, sf_dir):
    users = ST.users_from_logins(ST.login_log(V.submissions(spark, sf_dir)))
    deleted = users.filter(F.col("role") == "admin")
    return ST.cascade_delete(records(spark, sf_dir), deleted).select("record_id", "email")


@query
def q_user_records(spark, sf_dir):
    users = ST.users_from_logins(ST.login_log(V.submissions(spark, sf_dir)))
    j = ST.user_records(users, records(spark, sf_dir))
    return j.select(
        "email", "name", "role", F.col("login_count").cast("bigint").alias("login_count"),
        "record_id", "predicted_emotion",
    )


# ---------------------------------------------------------------------------
# Analytics over history
# ---------------------------------------------------------------------------


@query
def q_emotion_counts(spark, sf_dir):
    return A.emotion_counts(history(spark, sf_dir))


@query
def q_field_emotion_model_counts(spark, sf_dir):
    return A.field_emotion_model_counts(history(spark, sf_dir))


@query
def q_history_kpis(spark, sf_dir):
    k = A.history_kpis(history(spark, sf_dir))
    return k.select("interactions", r6("avg_confidence").alias("avg_confidence"), "most_common_emotion")


@query
def q_confidence_series(spark, sf_dir):
    s = A.confidence_series(history(spark, sf_dir))
    return s.select("seq", F.col("slot").cast("bigint").alias("slot"), "time", r6("confidence").alias("confidence"))


@query
def q_recent_sessions(spark, sf_dir):
    r = A.recent_sessions(history(spark, sf_dir))
    return r.select("seq", F.col("slot").cast("bigint").alias("slot"), "field", "emotion", r6("confidence").alias("confidence"))


@query
def q_history_summary(spark, sf_dir):
    h = A.history_summary(history(spark, sf_dir))
    return h.select(
        "seq", F.col("slot").cast("bigint").alias("slot"), T.iso_seconds("ts").alias("timestamp"), "field",
        "emotion", r6("confidence").alias("confidence"), "model", "response_type",
    )


# ---------------------------------------------------------------------------
# Labelled dataset preparation and split
# ---------------------------------------------------------------------------

from moodframe.functions.constants import DEFAULT_STOP_WORDS, MAX_SEQ_LEN  # noqa: E402
from moodframe.operators import dataset as D  # noqa: E402
from moodframe.operators import evaluation as EV  # noqa: E402
from moodframe.operators import features as FE  # noqa: E402


def prepared(spark, sf_dir, text=True):
    return D.prepare_dataset(V.labelled(spark, sf_dir), lemmas="corpus", text=text)


def split(spark, sf_dir, text=True):
    """Rows of a written table, told by their class's cut."""
    return D.split_stratified(prepared(spark, sf_dir, text))


@query
def q_src_null_tokens(spark, sf_dir):
    return V.labelled(spark, sf_dir).select("row_id", D.null_tokens_to_null("emotion").alias("emotion"))


@query
def q_label_normalize(spark, sf_dir):
    d = V.labelled(spark, sf_dir).select("row_id", D.null_tokens_to_null("emotion").alias("emotion")).dropna()
    return d.select("row_id", D.normalize_label("emotion").alias("emotion"))


@query
def q_label_domain_filter(spark, sf_dir):
    d = V.labelled(spark, sf_dir).select("row_id", D.null_tokens_to_null("emotion").alias("emotion")).dropna()
    return D.supported_labels(d.select("row_id", D.normalize_label("emotion").alias("emotion")))


@query
def q_label_encode(spark, sf_dir):
    d = q_label_domain_filter(spark, sf_dir)
    return d.select("row_id", "emotion", D.label_id("emotion").alias("label"))


@query
def q_remove_stopwords(spark, sf_dir):
    return D.training_text(V.texts(spark, sf_dir), "doc_id", stop_words=DEFAULT_STOP_WORDS).select("doc_id", "clean_text")


def _tokens_no_stop(spark, sf_dir):
    from moodframe.operators.partitioning import materialised

    return materialised(D.training_tokens(V.texts(spark, sf_dir), ["doc_id"]), "tokens")


@query
def q_lemma_table(spark, sf_dir):
    """Lemma table derived from the corpus vocabulary (noun suffix rules)."""
    return D.corpus_lemma_table(_tokens_no_stop(spark, sf_dir))


@query
def q_lemmatize_lookup(spark, sf_dir):
    toks = _tokens_no_stop(spark, sf_dir)
    out = T.lemmatize_tokens(toks, "doc_id", "tokens", D.corpus_lemma_table(toks))
    return out.select("doc_id", F.array_join("tokens", " ").alias("clean_text"))


@query
def q_clean_text_full(spark, sf_dir):
    return D.training_text(V.texts(spark, sf_dir), "doc_id", lemmas="corpus").select("doc_id", "clean_text")


@query
def q_prepare_dataset(spark, sf_dir):
    return prepared(spark, sf_dir).select("row_id", "emotion", "clean_text", "label")


@query
def q_label_distribution(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return p.groupBy("label", "emotion").agg(F.count(F.lit(1)).alias("n"))


@query
def q_split_stratified(spark, sf_dir):
    return split(spark, sf_dir).select("row_id", "label", "split")


@query
def q_split_sizes(spark, sf_dir):
    return split(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Vocabulary and sequences
# ---------------------------------------------------------------------------


def train_part(spark, sf_dir):
    return split(spark, sf_dir).filter(F.col("split") == "train")


@query
def q_vocab_fit(spark, sf_dir):
    return FE.vocab_fit(train_part(spark, sf_dir), "row_id")


@query
def q_vocab_size(spark, sf_dir):
    return FE.vocab_size(train_part(spark, sf_dir), "row_id")


def _encoded(spark, sf_dir, max_len=None):
    s = split(spark, sf_dir)
    vocab = FE.vocab_fit(s.filter(F.col("split") == "train"), "row_id")
    return FE.encode(s, vocab, "row_id", max_len=max_len)


@query
def q_encode_sequences(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select(
        "row_id",
        F.size("ids").cast("bigint").alias("n_ids"),
        F.size(F.filter("ids", lambda x: x == 1)).cast("bigint").alias("n_oov"),
        F.array_join("ids", " ").alias("ids"),
    )


@query
def q_pad_sequences(spark, sf_dir):
    e = _encoded(spark, sf_dir, MAX_SEQ_LEN)
    p = e.select("row_id", FE.pad("ids", MAX_SEQ_LEN).alias("padded"))
    return p.select(
        "row_id",
        F.size("padded").cast("bigint").alias("length"),
        F.array_join("padded", " ").alias("padded"),
    )


@query
def q_one_hot(spark, sf_dir):
    p = prepared(spark, sf_dir)
    oh = FE.one_hot("label")
    return p.select("row_id", "label", F.array_join(F.transform(oh, lambda x: x.cast("int")), " ").alias("one_hot"))


# ---------------------------------------------------------------------------
# Probability arrays: softmax, repair, fallback
# ---------------------------------------------------------------------------


@query
def q_softmax(spark, sf_dir):
    """Every entry of every softmax vector."""
    p = load_table(spark, sf_dir, "embeddings").select("vec_id", S.softmax("embedding").alias("p"))
    return p.select("vec_id", F.posexplode("p").alias("i", "v")).select("vec_id", F.col("i").cast("bigint").alias("i"), r6("v").alias("prob"))


def raw_vectors(spark, sf_dir):
    """(doc_id, v): non-negative vectors of 0 to 64 entries; every 13th sums to 0."""
    e = load_table(spark, sf_dir, "embeddings")
    keep = F.when(F.pmod("vec_id", F.lit(5)) == 0, F.lit(64)).otherwise(F.pmod("vec_id", F.lit(9))).cast("int")
    value = lambda x: F.when(F.pmod("vec_id", F.lit(13)) == 0, F.lit(0.0)).otherwise(F.greatest(x.cast("double"), F.lit(0.0)))
    return e.select(F.col("vec_id").alias("doc_id"), F.transform(F.slice("embedding", F.lit(1), keep), value).alias("v"))


@query
def q_prob_repair(spark, sf_dir):
    """Every entry of the repaired vectors; an empty vector gives none."""
    p = raw_vectors(spark, sf_dir).select("doc_id", S.prob_repair("v").alias("p"))
    return p.select("doc_id", F.posexplode("p").alias("i", "v")).select("doc_id", F.col("i").cast("bigint").alias("i"), r6("v").alias("prob"))


def external_scores(spark, sf_dir):
    """An external model-B output table keyed by doc_id: softmax of the stored
    embedding, sharpened and repaired to the seven labels (documents without
    one get none)."""
    e = load_table(spark, sf_dir, "embeddings")
    sharp = F.transform("embedding", lambda x: x.cast("double") * F.lit(8.0))
    return e.select(F.col("vec_id").alias("doc_id"), S.prob_repair(S.softmax(sharp)).alias("probs"))


def broken_scores(spark, sf_dir):
    """The external table with NaN, negative, null and short vectors in it."""
    k = F.pmod("doc_id", F.lit(17))
    first = lambda x: F.concat(F.array(F.lit(x)), F.slice("probs", 2, 6))
    probs = (
        F.when(k == 3, first(float("nan")))
        .when(k == 5, first(-1.0))
        .when(k == 7, F.lit(None).cast("array<double>"))
        .when(k == 9, F.slice("probs", 1, 3))
        .otherwise(F.col("probs"))
    )
    return external_scores(spark, sf_dir).select("doc_id", probs.alias("probs"))


@query
def q_predict_with_fallback(spark, sf_dir):
    from moodframe.operators.modeling import with_fallback

    out = with_fallback(scored_docs(spark, sf_dir), broken_scores(spark, sf_dir), "doc_id", "BiLSTM")
    return out.select("doc_id", "emotion", r6("confidence").alias("confidence"), "model")


# ---------------------------------------------------------------------------
# Evaluation: labelled truth vs keyword prediction
# ---------------------------------------------------------------------------


def eval_pairs(spark, sf_dir):
    p = prepared(spark, sf_dir).select("row_id", F.col("label").alias("actual"))
    kw = P.predict_keyword(V.texts(spark, sf_dir), ["doc_id"]).select(
        F.col("doc_id").alias("row_id"), F.coalesce(D.label_id("emotion"), F.lit(-1)).alias("predicted")
    )
    return p.join(kw, "row_id")


@query
def q_confusion_matrix(spark, sf_dir):
    return EV.confusion_long(eval_pairs(spark, sf_dir)).select(
        F.col("actual").cast("bigint").alias("actual"), F.col("predicted").cast("bigint").alias("predicted"), "n"
    )


@query
def q_confusion_matrix_wide(spark, sf_dir):
    w = EV.confusion_wide(eval_pairs(spark, sf_dir))
    return w.select(F.col("actual").cast("bigint").alias("actual"), *[F.col(f"pred_{i}").cast("bigint").alias(f"pred_{i}") for i in range(7)])


@query
def q_classification_report(spark, sf_dir):
    r = EV.classification_report(eval_pairs(spark, sf_dir))
    return r.select(
        F.col("label_id").cast("bigint").alias("label_id"), "emotion", r6("precision").alias("precision"),
        r6("recall").alias("recall"), r6("f1").alias("f1"), "support",
    )


@query
def q_weighted_metrics(spark, sf_dir):
    m = EV.weighted_metrics(eval_pairs(spark, sf_dir))
    return m.select(*[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]])


# ---------------------------------------------------------------------------
# Model training and scoring (MLlib; rows-only checks)
# ---------------------------------------------------------------------------


def binary_split(spark, sf_dir):
    """documents ⋈ labels (quality 0/1): a truth that text can predict.
    (doc_id, text, label, clean_text, split), written once."""
    from moodframe.operators.partitioning import materialised

    cleaned = D.training_text(V.binary(spark, sf_dir), "doc_id", keep=["label", "text"])
    return materialised(D.split_stratified(cleaned.filter(F.length("clean_text") > 0), key="doc_id"), "binary-split")


def _fitted(s, key, slot):
    """(model, vocabulary or None, input column, frame with that column)."""
    from moodframe.operators import modeling as M
    from moodframe.operators.partitioning import materialised

    of = lambda df, part: df.filter(F.col("split") == part)
    if slot == "a":
        return M.fit_model_a(of(s, "train")), None, "text", s
    vocab = materialised(FE.vocab_fit(of(s, "train"), key), "vocabulary")
    coded = materialised(M.as_ids(s.select(key, "label", "split", "clean_text"), vocab), "coded")
    return M.fit_model_b(of(coded, "train"), of(coded, "validation")), vocab, "ids", coded


def _validated(spark, sf_dir, slot):
    from moodframe.operators import modeling as M

    model, _, column, s = _fitted(binary_split(spark, sf_dir), "doc_id", slot)
    return M.predictions_for_eval(model, s.filter(F.col("split") == "validation"), column), s


def _metrics_row(pairs, n_train):
    m = EV.weighted_metrics(pairs)
    return m.select(
        *[r6(c).alias(c) for c in ["accuracy", "precision", "recall", "f1"]],
        F.lit(n_train).cast("bigint").alias("n_train"),
    )


@query
def q_train_model_b(spark, sf_dir):
    pairs, s = _validated(spark, sf_dir, "b")
    return _metrics_row(pairs, s.filter(F.col("split") == "train").count())


@query
def q_train_model_a(spark, sf_dir):
    pairs, s = _validated(spark, sf_dir, "a")
    return _metrics_row(pairs, s.filter(F.col("split") == "train").count())


@query
def q_evaluate_model(spark, sf_dir):
    """Report of the validation part: a row per class and the averages."""
    pairs, _ = _validated(spark, sf_dir, "b")
    return EV.classification_report(pairs, ["low", "high"])


@query
def q_training_history(spark, sf_dir):
    from moodframe.operators import modeling as M

    return M.training_history(_fitted(binary_split(spark, sf_dir), "doc_id", "b")[0])


@query
def q_evaluate_emotion_model(spark, sf_dir):
    """Report of slot B on the validation part of the emotion dataset: every
    class's support, and whether its figures agree with each other."""
    from moodframe.operators import modeling as M

    model, _, column, coded = _fitted(split(spark, sf_dir, text=False), "row_id", "b")
    report = EV.classification_report(M.predictions_for_eval(model, coded.filter(F.col("split") == "validation"), column))
    p, r, f1 = F.col("precision"), F.col("recall"), F.col("f1")
    share = lambda c: c.between(0.0, 1.0)
    own = share(p) & share(r) & (F.abs(f1 * (p + r) - 2 * p * r) < 1e-9)
    agrees = F.when(F.col("label_id") >= 0, own).otherwise(share(f1))
    return report.select(F.col("label_id").cast("bigint").alias("label_id"), "emotion", "support", agrees.alias("agrees"))


@query
def q_training_curve(spark, sf_dir):
    """What must hold for each epoch whatever the weights: losses and accuracies
    in their ranges, and the kept epoch being the one of least validation loss."""
    h = q_training_history(spark, sf_dir)
    least = F.min("validation_loss").over(Window.partitionBy())  # a row an epoch
    share = lambda c: F.col(c).between(0.0, 1.0)
    sound = (F.col("train_loss") > 0) & (F.col("validation_loss") > 0) & share("train_accuracy") & share("validation_accuracy")
    return h.select(F.col("epoch").cast("bigint").alias("epoch"), sound.alias("sound"), (F.col("is_best") == (F.col("validation_loss") == least)).alias("best_is_least"))


def _slot_rows(spark, sf_dir, slot):
    from moodframe.operators import modeling as M

    # slot A learns from the raw text, slot B from the cleaned one alone
    model, vocab, _, _ = _fitted(split(spark, sf_dir, text=slot == "a"), "row_id", slot)
    return M.score_slot(model, V.texts(spark, sf_dir), "doc_id", "BERT" if slot == "a" else "BiLSTM", vocab=vocab)


def _slot_checked(rows):
    """What must hold whatever the weights: seven scores that sum to 1, the
    emotion being the first of the largest, and the text as shown."""
    from moodframe.functions.constants import EMOTIONS

    values = F.transform(F.array(*[F.lit(e) for e in EMOTIONS]), lambda e: F.col("scores")[e])
    return rows.select(
        "doc_id",
        F.size("scores").cast("bigint").alias("n_scores"),
        r6(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        ((S.argmax_from_probs(values) == F.col("emotion")) & (F.array_max(values) == F.col("confidence"))).alias("is_top"),
        "cleaned_text",
        "model",
    )


@query
def q_predict_model_a(spark, sf_dir):
    return _slot_checked(_slot_rows(spark, sf_dir, "a"))


@query
def q_predict_model_b(spark, sf_dir):
    return _slot_checked(_slot_rows(spark, sf_dir, "b"))


# ---------------------------------------------------------------------------
# Streaming (run to completion with availableNow, then read the sink back)
# ---------------------------------------------------------------------------


@query
def q_stream_score_records(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return _records_out(J.records(spark, J.stream_records(spark, sf_dir)))


@query
def q_stream_users(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return _users_out(J.users(spark, J.stream_users(spark, sf_dir)))


@query
def q_stream_emotion_counts(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return J.latest_snapshot(spark, J.stream_emotion_counts(spark, sf_dir), "emotion_counts")


@query
def q_stream_field_emotion_model_counts(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return J.latest_snapshot(spark, J.stream_field_emotion_model_counts(spark, sf_dir), "field_emotion_model_counts")


@query
def q_stream_mean_confidence(spark, sf_dir):
    from moodframe.streaming import jobs as J

    m = J.mean_confidence(J.latest_snapshot(spark, J.stream_mean_confidence(spark, sf_dir), "mean_confidence"))
    return m.select("interactions", r6("avg_confidence").alias("avg_confidence"))


@query
def q_stream_examples(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return _examples_out(J.examples(spark, J.stream_logs(spark, sf_dir)))


@query
def q_stream_mapping(spark, sf_dir):
    from moodframe.streaming import jobs as J

    return J.mapping(spark, J.stream_logs(spark, sf_dir))
