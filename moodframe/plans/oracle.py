"""DuckDB oracle SQL, one statement per query in ``moodframe.plans.registry``.

Tables are the driver's pre-registered views.  Column names and types match
the Spark side; doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from moodframe.functions.constants import EMOTIONS, GUIDANCE, KEYWORDS, RESPONSE_TYPE, keyword_weight
from moodframe.plans.sqlfrag import (
    LABELLED_VIEW,
    PHRASES_VIEW,
    SUBMISSIONS_VIEW,
    clean_sql,
    q,
    scored_cte,
    unpivot_sql,
)

ORACLE: dict[str, str] = {}

SCORED_DOCS = scored_cte("documents", ["doc_id"])
SCORED_CHAT = scored_cte("conversations", ["conv_id", "turn"])
LABEL_DIM = "(VALUES " + ", ".join(f"({i}, {q(e)})" for i, e in enumerate(EMOTIONS)) + ") AS emotions(label_id, emotion)"
GUIDANCE_DIM = (
    "(VALUES "
    + ", ".join(f"({q(e)}, {q(r)}, {q(a)})" for e, (r, a) in GUIDANCE.items())
    + ") AS guidance(emotion, response, action)"
)
LEXICON_DIM = (
    "(VALUES "
    + ", ".join(f"({q(e)}, {q(kw)}, {keyword_weight(e, kw)})" for e in EMOTIONS for kw in KEYWORDS[e])
    + ") AS lexicon(emotion, keyword, weight)"
)

# sorted label array as a DuckDB list of structs: sorted by tenths desc, label id asc
RANKED_LONG = f"""
    (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tenths DESC, label_id) AS rank
     FROM {unpivot_sql('sd', ['doc_id'])} u)
"""


def _mixed_long(src_alias: str = "sd") -> str:
    return f"""
    (SELECT doc_id, rank, emotion, tenths, total_tenths FROM
       (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tenths DESC, label_id) AS rank
        FROM {unpivot_sql(src_alias, ['doc_id'])} u) r
     WHERE rank = 1 OR 20 * tenths >= 3 * total_tenths)
    """


ORACLE["clean_text"] = f"SELECT doc_id, {clean_sql('text')} AS cleaned_text FROM documents"
ORACLE["clean_text_chat"] = (
    f"SELECT conv_id, turn, {clean_sql('text')} AS cleaned_text FROM conversations"
)


def _contractions_sql(col: str) -> str:
    from moodframe.functions.constants import CONTRACTIONS

    out = col
    for short, long in CONTRACTIONS:
        out = f"replace({out}, {q(short)}, {q(long)})"
    return out


ORACLE["expand_contractions"] = (
    f"SELECT conv_id, turn, {_contractions_sql('lower(text)')} AS expanded FROM {PHRASES_VIEW} ph"
)
ORACLE["clean_text_phrases"] = f"SELECT conv_id, turn, {clean_sql('text')} AS cleaned_text FROM {PHRASES_VIEW} ph"


def _url_sql(col: str) -> str:
    from moodframe.functions.text import URL_PATTERN

    return f"regexp_replace({col}, {q(URL_PATTERN)}, ' ', 'g')"


ORACLE["strip_urls"] = (
    f"SELECT page_id, {_url_sql('lower(url)')} AS url_stripped, {clean_sql('html')} AS cleaned_html FROM pages"
)
ORACLE["tokenize"] = f"""
    SELECT doc_id,
           CAST(CASE WHEN c = '' THEN 0 ELSE len(string_split(c, ' ')) END AS BIGINT) AS n_tokens,
           c AS rejoined
    FROM (SELECT doc_id, {clean_sql('text')} AS c FROM documents) t
"""
ORACLE["iso_seconds"] = """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts_iso, strftime(ts, '%H:%M:%S') AS time FROM events
"""

ORACLE["predict_keyword"] = f"""
    SELECT doc_id, emotion, round(confidence, 6) AS confidence,
           CAST(total_tenths AS BIGINT) AS total_tenths, 'Keyword Fallback' AS model
    FROM {SCORED_DOCS} sd
"""
ORACLE["predict_keyword_chat"] = f"""
    SELECT conv_id, turn, emotion, round(confidence, 6) AS confidence FROM {SCORED_CHAT} sc
"""
ORACLE["keyword_scores"] = f"""
    WITH sd AS {SCORED_DOCS}
    SELECT doc_id, emotion, CAST(tenths AS BIGINT) AS tenths,
           round(CAST(tenths AS DOUBLE) / total_tenths, 6) AS score
    FROM {unpivot_sql('sd', ['doc_id'])} u
"""
ORACLE["emotion_distribution"] = f"""
    SELECT emotion, count(*) AS n_docs, round(avg(confidence), 6) AS avg_confidence
    FROM {SCORED_DOCS} sd GROUP BY emotion
"""
ORACLE["mixed_emotions"] = f"""
    WITH sd AS {SCORED_DOCS}
    SELECT doc_id, CAST(rank AS BIGINT) AS rank, emotion,
           round(CAST(tenths AS DOUBLE) / total_tenths, 6) AS score
    FROM {_mixed_long()} m
"""
ORACLE["mixed_label"] = f"""
    WITH sd AS {SCORED_DOCS}, m AS {_mixed_long()}
    SELECT sd.doc_id, sd.emotion,
           CASE WHEN g.n > 1 THEN g.label ELSE sd.emotion END AS mixed_label
    FROM sd JOIN (SELECT doc_id, count(*) AS n, string_agg(emotion, ' + ' ORDER BY rank) AS label
                  FROM m GROUP BY doc_id) g ON g.doc_id = sd.doc_id
"""
ORACLE["secondary_emotion"] = f"""
    WITH sd AS {SCORED_DOCS}, m AS {_mixed_long()}
    SELECT sd.doc_id, m.emotion AS secondary_emotion
    FROM sd LEFT JOIN m ON m.doc_id = sd.doc_id AND m.rank = 2
"""
ORACLE["ranked_scores"] = f"""
    WITH sd AS {SCORED_DOCS}
    SELECT doc_id, CAST(rank AS BIGINT) AS rank, emotion,
           round(CAST(tenths AS DOUBLE) / total_tenths, 6) AS score
    FROM {RANKED_LONG} r
"""
ORACLE["dense_scores"] = f"""
    WITH sd AS {SCORED_DOCS}
    SELECT doc_id, CAST(label_id AS BIGINT) AS label_id, emotion,
           CASE WHEN tenths > 2 THEN round(CAST(tenths AS DOUBLE) / total_tenths, 6) ELSE 0.0 END AS score
    FROM {unpivot_sql('sd', ['doc_id'])} u
"""
ORACLE["guidance_join"] = f"""
    SELECT sd.doc_id, sd.emotion, g.response, g.action, {q(RESPONSE_TYPE)} AS response_type
    FROM {SCORED_DOCS} sd LEFT JOIN {GUIDANCE_DIM} ON g.emotion = sd.emotion
""".replace("AS guidance(", "AS g(")
ORACLE["keyword_hits_join"] = f"""
    SELECT sd.doc_id, lx.emotion, CAST(sum(CASE WHEN contains(sd.cleaned_text, lx.keyword) THEN 1 ELSE 0 END) AS BIGINT) AS n_hits,
           CAST(2 + sum(CASE WHEN contains(sd.cleaned_text, lx.keyword) THEN lx.weight ELSE 0 END) AS BIGINT) AS tenths
    FROM {SCORED_DOCS} sd, {LEXICON_DIM}
    GROUP BY sd.doc_id, lx.emotion
""".replace("AS lexicon(", "AS lx(")


# ---------------------------------------------------------------------------
# Submissions → history → records / users / logs
# ---------------------------------------------------------------------------

from moodframe.functions.text import WS_RUN_PATTERN  # noqa: E402
from moodframe.plans.registry import SAMPLE_EMAIL, SNAPSHOT_CUTOFF  # noqa: E402


def trim_ws_sql(col: str) -> str:
    return f"regexp_replace({col}, {q(WS_RUN_PATTERN)}, '', 'g')"


def iso_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%S')"


GUIDE = GUIDANCE_DIM.replace("AS guidance(", "AS gd(")

HISTORY_CTES = f"""
    sd AS {SCORED_DOCS},
    m AS {_mixed_long()},
    mg AS (SELECT doc_id, count(*) AS n, string_agg(emotion, ' + ' ORDER BY rank) AS label,
                  max(CASE WHEN rank = 2 THEN emotion END) AS secondary
           FROM m GROUP BY doc_id),
    sdm AS (SELECT sd.doc_id, sd.emotion, sd.confidence,
                   CASE WHEN mg.n > 1 THEN mg.label ELSE sd.emotion END AS mixed_label,
                   mg.secondary
            FROM sd JOIN mg ON mg.doc_id = sd.doc_id),
    subs AS {SUBMISSIONS_VIEW},
    v AS (SELECT seq, ts, doc_id, {trim_ws_sql('email')} AS email,
                 coalesce(nullif({trim_ws_sql('name')}, ''), 'Learner') AS name,
                 coalesce(nullif(role, ''), 'student') AS role,
                 field, text, model_choice, save
          FROM subs WHERE text IS NOT NULL AND {trim_ws_sql('text')} <> ''),
    h AS (SELECT v.seq, v.ts, v.doc_id, v.email, v.name, v.role, v.field, v.text, v.model_choice, v.save,
                 rt.slot,
                 CASE rt.slot WHEN 0 THEN 'BERT Fallback' ELSE 'BiLSTM Fallback' END AS model,
                 sdm.emotion AS primary_emotion, sdm.mixed_label AS emotion, sdm.secondary AS secondary_emotion,
                 sdm.confidence, sdm.emotion AS selected_emotion, sdm.confidence AS selected_confidence,
                 gd.response AS ai_response, {q(RESPONSE_TYPE)} AS response_type
          FROM v JOIN sdm ON sdm.doc_id = v.doc_id
          JOIN (VALUES ('bert', 0), ('bilstm', 1), ('compare', 0), ('compare', 1)) rt(choice, slot)
            ON rt.choice = lower(v.model_choice)
          LEFT JOIN {GUIDE} ON gd.emotion = sdm.emotion),
    rec AS (SELECT row_number() OVER (ORDER BY ts, seq, slot) AS record_id, email, field,
                   text AS input_text, primary_emotion AS predicted_emotion, secondary_emotion,
                   confidence AS confidence_score, model AS model_used, ai_response, response_type,
                   {iso_sql('ts')} AS timestamp, true AS csv_logged, slot, seq, doc_id
            FROM h WHERE save),
    logins AS (SELECT email, name, role, ts, seq FROM v WHERE save),
    users AS (SELECT email, arg_max(name, (ts, seq)) AS name, arg_max(role, (ts, seq)) AS role,
                     count(*) AS login_count, min(ts) AS created_at FROM logins GROUP BY email),
    users_before AS (SELECT email FROM logins WHERE ts < TIMESTAMP '{SNAPSHOT_CUTOFF}' GROUP BY email),
    ex AS (SELECT seq, ts, text, lower(selected_emotion) AS emotion, selected_confidence AS confidence,
                  ai_response AS response, field, {iso_sql('ts')} AS timestamp
           FROM h WHERE save AND (lower(model_choice) <> 'compare' OR slot = 0))
"""

REC_COLS = """record_id, email, field, predicted_emotion, secondary_emotion,
              round(confidence_score, 6) AS confidence_score, model_used, ai_response, response_type,
              timestamp, csv_logged"""


def with_history(select: str) -> str:
    return f"WITH {HISTORY_CTES} {select}"


ORACLE["submissions_valid"] = with_history("SELECT seq, doc_id, field, model_choice, save FROM v")
ORACLE["submissions_rejected"] = with_history(
    f"SELECT seq, doc_id FROM subs WHERE text IS NULL OR {trim_ws_sql('text')} = ''"
)
ORACLE["submission_identity"] = with_history(
    f"""SELECT seq, {trim_ws_sql('email')} AS email,
               coalesce(nullif({trim_ws_sql('name')}, ''), 'Learner') AS name,
               coalesce(nullif(role, ''), 'student') AS role FROM subs"""
)
ORACLE["route_models"] = with_history(
    """SELECT v.seq, CAST(rt.slot AS BIGINT) AS slot FROM v
       JOIN (VALUES ('bert', 0), ('bilstm', 1), ('compare', 0), ('compare', 1)) rt(choice, slot)
       ON rt.choice = lower(v.model_choice)"""
)
ORACLE["history_rows"] = with_history(
    f"""SELECT seq, CAST(slot AS BIGINT) AS slot, {iso_sql('ts')} AS timestamp, field, emotion,
               primary_emotion, secondary_emotion, round(confidence, 6) AS confidence, ai_response,
               model, response_type FROM h"""
)
TWO_SLOTS = f"""
    e1 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8.0) AS e FROM embeddings),
    e2 AS (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS ex FROM e1),
    e3 AS (SELECT vec_id, list_slice(ex, 1, 7) AS s7 FROM e2),
    ext AS (SELECT vec_id AS doc_id, list_transform(s7, lambda x: x / list_sum(s7)) AS p FROM e3),
    two AS (SELECT h.seq, h.slot, h.model_choice,
                   CASE WHEN h.slot = 1 AND ext.p IS NOT NULL
                        THEN ([{", ".join(q(e) for e in EMOTIONS)}])[list_position(ext.p, list_max(ext.p))] ELSE h.primary_emotion END AS emotion,
                   CASE WHEN h.slot = 1 AND ext.p IS NOT NULL THEN list_max(ext.p) ELSE h.confidence END AS confidence,
                   CASE WHEN h.slot = 0 THEN 'BERT Fallback' WHEN ext.p IS NOT NULL THEN 'BiLSTM' ELSE 'BiLSTM Fallback' END AS model
            FROM h LEFT JOIN ext ON ext.doc_id = h.doc_id)
"""
ORACLE["select_best_model"] = f"""WITH {HISTORY_CTES}, {TWO_SLOTS}
    SELECT seq, CAST(slot AS BIGINT) AS slot, emotion, round(confidence, 6) AS confidence, model FROM
      (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY confidence DESC, slot) AS k FROM two) t WHERE k = 1"""
ORACLE["compare_models"] = f"""WITH {HISTORY_CTES}, {TWO_SLOTS}
    SELECT seq, CASE slot WHEN 0 THEN 'bert' ELSE 'bilstm' END AS model_key, emotion, round(confidence, 6) AS confidence, model
    FROM two WHERE lower(model_choice) = 'compare'"""
ORACLE["records_build"] = with_history(f"SELECT {REC_COLS}, input_text FROM rec")
ORACLE["records_all"] = with_history(f"SELECT {REC_COLS} FROM rec")
ORACLE["records_by_user"] = with_history(f"SELECT {REC_COLS} FROM rec WHERE email = {q(SAMPLE_EMAIL)}")
ORACLE["scores_json_roundtrip"] = with_history(
    f"""SELECT rec.record_id, u.emotion, round(CAST(u.tenths AS DOUBLE) / u.total_tenths, 6) AS score
        FROM rec JOIN {unpivot_sql('sd', ['doc_id'])} u ON u.doc_id = rec.doc_id"""
)
USERS_OUT = f"email, name, role, CAST(login_count AS BIGINT) AS login_count, {iso_sql('created_at')} AS created_at"
ORACLE["users_upsert_batch"] = with_history(f"SELECT {USERS_OUT} FROM users")
ORACLE["users_upsert_incremental"] = ORACLE["users_upsert_batch"]
ORACLE["examples_append"] = with_history(
    "SELECT seq, emotion, round(confidence, 6) AS confidence, response, field, timestamp FROM ex"
)
ORACLE["examples_count"] = with_history("SELECT count(*) AS n_examples FROM ex")
ORACLE["mapping_insert_if_absent"] = with_history(
    """SELECT selected_emotion AS emotion, arg_min(ai_response, (ts, seq)) AS response
       FROM h WHERE save AND (lower(model_choice) <> 'compare' OR slot = 0) GROUP BY selected_emotion"""
)
ORACLE["fk_valid"] = with_history(
    "SELECT record_id, email FROM rec WHERE email IN (SELECT email FROM users_before)"
)
ORACLE["fk_violations"] = with_history(
    "SELECT record_id, email FROM rec WHERE email NOT IN (SELECT email FROM users_before)"
)
ORACLE["cascade_delete"] = with_history(
    "SELECT record_id, email FROM rec WHERE email NOT IN (SELECT email FROM users WHERE role = 'admin')"
)
ORACLE["user_records"] = with_history(
    """SELECT users.email, users.name, users.role, CAST(users.login_count AS BIGINT) AS login_count,
              rec.record_id, rec.predicted_emotion
       FROM users JOIN rec ON rec.email = users.email"""
)
ORACLE["emotion_counts"] = with_history("SELECT emotion, count(*) AS count FROM h GROUP BY emotion")
ORACLE["field_emotion_model_counts"] = with_history(
    "SELECT field, emotion, model, count(*) AS count FROM h GROUP BY field, emotion, model"
)
ORACLE["history_kpis"] = with_history(
    """SELECT (SELECT count(*) FROM h) AS interactions,
              (SELECT round(avg(confidence), 6) FROM h) AS avg_confidence,
              (SELECT emotion FROM h GROUP BY emotion ORDER BY count(*) DESC, emotion LIMIT 1)
                AS most_common_emotion"""
)
ORACLE["confidence_series"] = with_history(
    "SELECT seq, CAST(slot AS BIGINT) AS slot, strftime(ts, '%H:%M:%S') AS time, round(confidence, 6) AS confidence FROM h"
)
ORACLE["recent_sessions"] = with_history(
    """SELECT seq, CAST(slot AS BIGINT) AS slot, field, emotion, round(confidence, 6) AS confidence
       FROM h ORDER BY ts DESC, seq DESC, slot DESC LIMIT 3"""
)
ORACLE["history_summary"] = with_history(
    f"""SELECT seq, CAST(slot AS BIGINT) AS slot, {iso_sql('ts')} AS timestamp, field, emotion,
               round(confidence, 6) AS confidence, model, response_type FROM h"""
)


# ---------------------------------------------------------------------------
# Labelled dataset, split, vocabulary, sequences, evaluation
# ---------------------------------------------------------------------------

from moodframe.functions.constants import (  # noqa: E402
    CSV_NULL_TOKENS,
    DEFAULT_STOP_WORDS,
    MAX_SEQ_LEN,
    NOUN_SUFFIX_RULES,
    VOCAB_NUM_WORDS,
)

TOKENS_LIST = "(" + ", ".join(q(t) for t in CSV_NULL_TOKENS) + ")"
STOP_LIST = "[" + ", ".join(q(w) for w in sorted(set(DEFAULT_STOP_WORDS))) + "]"
EMO_LIST = "[" + ", ".join(q(e) for e in EMOTIONS) + "]"
RULES_DIM = (
    "(VALUES " + ", ".join(f"({i + 1}, {q(s)}, {q(r)})" for i, (s, r) in enumerate(NOUN_SUFFIX_RULES)) + ") AS rules(r, suf, rep)"
)


def nulltok(col: str) -> str:
    return f"CASE WHEN {col} IN {TOKENS_LIST} THEN NULL ELSE {col} END"


def toks_sql(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda x: x <> '')"


def nostop_sql(cleaned: str) -> str:
    return f"list_filter(string_split({cleaned}, ' '), lambda x: x <> '' AND NOT list_contains({STOP_LIST}, x))"


PREP_CTES = f"""
    lab AS {LABELLED_VIEW},
    l1 AS (SELECT row_id, {nulltok('text')} AS text, {nulltok('emotion')} AS emotion FROM lab),
    l2 AS (SELECT row_id, text, upper(left(e, 1)) || lower(substr(e, 2)) AS emotion
           FROM (SELECT row_id, text, {trim_ws_sql('emotion')} AS e FROM l1
                 WHERE text IS NOT NULL AND emotion IS NOT NULL) t),
    l3 AS (SELECT * FROM l2 WHERE emotion IN (SELECT unnest({EMO_LIST}))),
    tk AS (SELECT row_id, {nostop_sql(clean_sql('text'))} AS toks FROM l3),
    words AS (SELECT DISTINCT unnest(toks) AS word FROM tk),
    cands AS (SELECT w.word, rules.r, left(w.word, length(w.word) - length(rules.suf)) || rules.rep AS cand
              FROM words w JOIN {RULES_DIM} ON suffix(w.word, rules.suf) AND length(w.word) > length(rules.suf)),
    lem AS (SELECT word AS surface, lemma FROM
              (SELECT c.word, arg_min(c.cand, (length(c.cand), c.r)) AS lemma
               FROM cands c JOIN words w2 ON w2.word = c.cand GROUP BY c.word) b WHERE length(lemma) < length(word)),
    tp AS (SELECT row_id, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS tok FROM tk),
    lt AS (SELECT tp.row_id, string_agg(coalesce(lem.lemma, tp.tok), ' ' ORDER BY tp.pos) AS clean_text
           FROM tp LEFT JOIN lem ON lem.surface = tp.tok GROUP BY tp.row_id),
    prep AS (SELECT l3.row_id, l3.text, l3.emotion, lt.clean_text, CAST(list_position({EMO_LIST}, l3.emotion) - 1 AS INTEGER) AS label
             FROM l3 JOIN lt ON lt.row_id = l3.row_id),
    cnt AS (SELECT label, count(*) AS c FROM prep GROUP BY label),
    tot AS (SELECT CAST(sum(c) AS BIGINT) AS n, min(c) AS c_min, count(*) AS k FROM cnt),
    q0 AS (SELECT cnt.label, cnt.c, tot.n, tot.c_min,
                  CAST(ceil(CAST(0.2 AS DOUBLE) * tot.n) AS BIGINT) AS n_val,
                  tot.n - CAST(ceil(CAST(0.2 AS DOUBLE) * tot.n) AS BIGINT) AS n_train
           FROM cnt, tot),
    q1 AS (SELECT *, CAST(c AS DOUBLE) / CAST(n AS DOUBLE) * CAST(n_train AS DOUBLE) AS cont FROM q0),
    q2 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS base, cont - floor(cont) AS rem FROM q1),
    quotas AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                                         <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS train_q
               FROM q2),
    split AS (SELECT p.row_id, p.label, p.clean_text,
                     CASE WHEN row_number() OVER (PARTITION BY p.label ORDER BY md5('42|' || CAST(p.row_id AS VARCHAR)), p.row_id) - 1
                               < qu.train_q THEN 'train' ELSE 'validation' END AS split
              FROM prep p JOIN quotas qu ON qu.label = p.label),
    wp AS (SELECT row_id, split, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS word
           FROM (SELECT row_id, split, {toks_sql('clean_text')} AS toks FROM split) t),
    perdoc AS (SELECT word, row_id, count(*) AS n, min(pos) AS p FROM wp WHERE split = 'train' GROUP BY word, row_id),
    stats AS (SELECT word, sum(n) AS word_count, count(*) AS doc_count, min(row_id) AS fk, arg_min(p, row_id) AS fp
              FROM perdoc GROUP BY word),
    vocab AS (SELECT word, CAST(row_number() OVER (ORDER BY word_count DESC, fk, fp) + 1 AS INTEGER) AS index,
                                    CAST(word_count AS BIGINT) AS word_count, CAST(doc_count AS BIGINT) AS doc_count
              FROM stats),
    enc AS (SELECT wp.row_id, list(CASE WHEN v.index < {VOCAB_NUM_WORDS} THEN v.index ELSE 1 END ORDER BY wp.pos) AS ids
            FROM wp LEFT JOIN vocab v ON v.word = wp.word GROUP BY wp.row_id)
"""


def with_prep(select: str) -> str:
    return f"WITH {PREP_CTES} {select}"


ORACLE["src_null_tokens"] = f"SELECT row_id, {nulltok('emotion')} AS emotion FROM {LABELLED_VIEW} lab"
ORACLE["label_normalize"] = with_prep(
    f"SELECT row_id, upper(left(e, 1)) || lower(substr(e, 2)) AS emotion FROM (SELECT row_id, {trim_ws_sql('emotion')} AS e FROM l1 WHERE emotion IS NOT NULL) t"
)
ORACLE["label_domain_filter"] = with_prep(
    f"""SELECT row_id, emotion FROM (SELECT row_id, upper(left(e, 1)) || lower(substr(e, 2)) AS emotion
        FROM (SELECT row_id, {trim_ws_sql('emotion')} AS e FROM l1 WHERE emotion IS NOT NULL) t) u
        WHERE emotion IN (SELECT unnest({EMO_LIST}))"""
)
ORACLE["label_encode"] = with_prep(
    f"""SELECT row_id, emotion, CAST(list_position({EMO_LIST}, emotion) - 1 AS INTEGER) AS label
        FROM (SELECT row_id, upper(left(e, 1)) || lower(substr(e, 2)) AS emotion
        FROM (SELECT row_id, {trim_ws_sql('emotion')} AS e FROM l1 WHERE emotion IS NOT NULL) t) u
        WHERE emotion IN (SELECT unnest({EMO_LIST}))"""
)
ORACLE["remove_stopwords"] = (
    f"SELECT doc_id, array_to_string({nostop_sql(clean_sql('text'))}, ' ') AS clean_text FROM documents"
)
LEMMA_CTES = f"""
    tk AS (SELECT doc_id, {nostop_sql(clean_sql('text'))} AS toks FROM documents),
    words AS (SELECT DISTINCT unnest(toks) AS word FROM tk),
    cands AS (SELECT w.word, rules.r, left(w.word, length(w.word) - length(rules.suf)) || rules.rep AS cand
              FROM words w JOIN {RULES_DIM} ON suffix(w.word, rules.suf) AND length(w.word) > length(rules.suf)),
    valid AS (SELECT c.* FROM cands c JOIN words w2 ON w2.word = c.cand),
    best AS (SELECT word, arg_min(cand, (length(cand), r)) AS lemma FROM valid GROUP BY word),
    lem AS (SELECT word AS surface, lemma FROM best WHERE length(lemma) < length(word)),
    tp AS (SELECT doc_id, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS tok FROM tk),
    lemmatized AS (SELECT tk.doc_id,
                          coalesce(string_agg(coalesce(lem.lemma, tp.tok), ' ' ORDER BY tp.pos), '') AS clean_text
                   FROM tk LEFT JOIN tp ON tp.doc_id = tk.doc_id LEFT JOIN lem ON lem.surface = tp.tok
                   GROUP BY tk.doc_id)
"""
ORACLE["lemma_table"] = f"WITH {LEMMA_CTES} SELECT surface, lemma FROM lem"
ORACLE["lemmatize_lookup"] = f"WITH {LEMMA_CTES} SELECT doc_id, clean_text FROM lemmatized"
ORACLE["clean_text_full"] = ORACLE["lemmatize_lookup"]
ORACLE["prepare_dataset"] = with_prep("SELECT row_id, emotion, clean_text, label FROM prep")
ORACLE["label_distribution"] = with_prep("SELECT label, emotion, count(*) AS n FROM prep GROUP BY label, emotion")
ORACLE["split_stratified"] = with_prep("SELECT row_id, label, split FROM split")
ORACLE["split_sizes"] = with_prep("SELECT label, split, count(*) AS n FROM split GROUP BY label, split")
ORACLE["evaluate_emotion_model"] = with_prep(
    """SELECT CAST(label AS BIGINT) AS label_id, emotion, count(*) AS support, true AS agrees FROM prep JOIN split USING (row_id, label)
       WHERE split = 'validation' GROUP BY ALL
       UNION ALL SELECT a.label_id, a.emotion, (SELECT count(*) FROM split WHERE split = 'validation'), true
       FROM (VALUES (-3, 'accuracy'), (-2, 'macro avg'), (-1, 'weighted avg')) a(label_id, emotion)"""
)
ORACLE["training_curve"] = "SELECT CAST(unnest(range(1, 11)) AS BIGINT) AS epoch, true AS sound, true AS best_is_least"
ORACLE["vocab_fit"] = with_prep("SELECT word, index, word_count, doc_count FROM vocab")
ORACLE["vocab_size"] = with_prep(
    f"""SELECT CAST(count(*) AS BIGINT) AS n_words, CAST(least({VOCAB_NUM_WORDS}, count(*) + 2) AS BIGINT) AS vocab_size
        FROM (SELECT DISTINCT word FROM wp WHERE split = 'train') t"""
)
ORACLE["encode_sequences"] = with_prep(
    """SELECT row_id, CAST(len(ids) AS BIGINT) AS n_ids, CAST(len(list_filter(ids, lambda x: x = 1)) AS BIGINT) AS n_oov,
              array_to_string(ids, ' ') AS ids FROM enc"""
)
ORACLE["pad_sequences"] = with_prep(
    f"""SELECT row_id, CAST({MAX_SEQ_LEN} AS BIGINT) AS length,
              array_to_string(list_slice(list_concat(ids, list_transform(range({MAX_SEQ_LEN}), lambda x: 0)), 1, {MAX_SEQ_LEN}), ' ') AS padded
        FROM enc"""
)
ORACLE["one_hot"] = with_prep(
    "SELECT row_id, label, array_to_string(list_transform(range(7), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ' ') AS one_hot FROM prep"
)

ORACLE["softmax"] = """
    SELECT vec_id, CAST(unnest(range(len(ex))) AS BIGINT) AS i, round(unnest(list_transform(ex, lambda x: x / list_sum(ex))), 6) AS prob
    FROM (SELECT vec_id, list_transform(e, lambda x: exp(x - list_max(e))) AS ex
          FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) a) b
"""


def repair_sql(arr: str) -> str:
    resized = f"list_transform(range(7), lambda i: ({arr})[(i % len({arr})) + 1])"
    return f"""(SELECT CASE WHEN list_sum(rz) <> 0 THEN list_transform(rz, lambda x: x / list_sum(rz))
                      ELSE list_transform(range(7), lambda i: 1.0 / 7) END FROM (SELECT {resized} AS rz))"""


ORACLE["prob_repair"] = f"""
    SELECT doc_id, CAST(unnest(range(7)) AS BIGINT) AS i, round(unnest(p), 6) AS prob FROM
      (SELECT doc_id, {repair_sql('v')} AS p FROM
        (SELECT vec_id AS doc_id, list_transform(list_slice(embedding, 1, CASE WHEN vec_id % 5 = 0 THEN 64 ELSE vec_id % 9 END),
                  lambda x: CASE WHEN vec_id % 13 = 0 THEN 0.0 ELSE greatest(CAST(x AS DOUBLE), 0.0) END) AS v FROM embeddings) a
       WHERE len(v) > 0) b
"""
ORACLE["predict_with_fallback"] = f"""
    WITH {HISTORY_CTES}, {TWO_SLOTS},
         used AS (SELECT doc_id, CASE WHEN doc_id % 17 = 9 THEN {repair_sql('list_slice(p, 1, 3)')} ELSE p END AS p
                  FROM ext WHERE doc_id % 17 NOT IN (3, 5, 7))
    SELECT sd.doc_id,
           CASE WHEN used.p IS NULL THEN sd.emotion ELSE ({EMO_LIST})[list_position(used.p, list_max(used.p))] END AS emotion,
           round(CASE WHEN used.p IS NULL THEN sd.confidence ELSE list_max(used.p) END, 6) AS confidence,
           CASE WHEN used.p IS NULL THEN 'BiLSTM Fallback' ELSE 'BiLSTM' END AS model
    FROM sd LEFT JOIN used ON used.doc_id = sd.doc_id
"""

EVAL_CTES = f"""
    {PREP_CTES},
    sd AS {SCORED_DOCS},
    pairs AS (SELECT prep.row_id, prep.label AS actual, CAST(list_position({EMO_LIST}, sd.emotion) - 1 AS INTEGER) AS predicted
              FROM prep JOIN sd ON sd.doc_id = prep.row_id),
    cm0 AS (SELECT actual, predicted, count(*) AS n FROM pairs GROUP BY actual, predicted),
    cm AS (SELECT g.a AS actual, g.p AS predicted, CAST(coalesce(cm0.n, 0) AS BIGINT) AS n
           FROM (SELECT a.a, b.p FROM range(7) a(a), range(7) b(p)) g
           LEFT JOIN cm0 ON cm0.actual = g.a AND cm0.predicted = g.p),
    pc0 AS (SELECT l.i AS label_id,
                   (SELECT n FROM cm WHERE actual = l.i AND predicted = l.i) AS tp,
                   (SELECT sum(n) FROM cm WHERE actual = l.i) AS support,
                   (SELECT sum(n) FROM cm WHERE predicted = l.i) AS predicted_n
            FROM range(7) l(i)),
    pc1 AS (SELECT label_id, support,
                   CASE WHEN predicted_n > 0 THEN CAST(tp AS DOUBLE) / predicted_n ELSE 0.0 END AS precision,
                   CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM pc0),
    pc AS (SELECT label_id, ({EMO_LIST})[label_id + 1] AS emotion, precision, recall,
                  CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
                  CAST(support AS BIGINT) AS support FROM pc1)
"""


def with_eval(select: str) -> str:
    return f"WITH {EVAL_CTES} {select}"


ORACLE["confusion_matrix"] = with_eval("SELECT CAST(actual AS BIGINT) AS actual, CAST(predicted AS BIGINT) AS predicted, n FROM cm")
ORACLE["confusion_matrix_wide"] = with_eval(
    "SELECT CAST(actual AS BIGINT) AS actual, "
    + ", ".join(f"CAST(sum(CASE WHEN predicted = {i} THEN n END) AS BIGINT) AS pred_{i}" for i in range(7))
    + " FROM cm GROUP BY actual"
)
ORACLE["classification_report"] = with_eval(
    """SELECT CAST(label_id AS BIGINT) AS label_id, emotion, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, support FROM pc
       UNION ALL
       SELECT -3, 'accuracy', NULL, NULL, round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6), count(*) FROM pairs
       UNION ALL
       SELECT -2, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc
       UNION ALL
       SELECT -1, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
              round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc"""
)
ORACLE["weighted_metrics"] = with_eval(
    """SELECT (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) FROM pairs) AS accuracy,
              round(sum(precision * support) / sum(support), 6) AS precision,
              round(sum(recall * support) / sum(support), 6) AS recall,
              round(sum(f1 * support) / sum(support), 6) AS f1 FROM pc"""
)


# Streaming jobs equal their batch counterparts.
ORACLE["stream_score_records"] = ORACLE["records_all"]
ORACLE["stream_users"] = ORACLE["users_upsert_batch"]
ORACLE["stream_emotion_counts"] = ORACLE["emotion_counts"]
ORACLE["stream_examples"] = ORACLE["examples_append"]
ORACLE["stream_mapping"] = ORACLE["mapping_insert_if_absent"]
ORACLE["stream_field_emotion_model_counts"] = ORACLE["field_emotion_model_counts"]
ORACLE["stream_mean_confidence"] = with_history("SELECT count(*) AS interactions, round(avg(confidence), 6) AS avg_confidence FROM h")

# Whatever the weights are, a slot's output has this structure.
ORACLE["predict_model_a"] = f"""
    SELECT doc_id, CAST(7 AS BIGINT) AS n_scores, 1.0 AS total, true AS is_top, {trim_ws_sql('text')} AS cleaned_text, 'BERT' AS model FROM documents
"""
ORACLE["predict_model_b"] = f"""
    SELECT doc_id, CAST(7 AS BIGINT) AS n_scores, 1.0 AS total, true AS is_top, {clean_sql('text')} AS cleaned_text, 'BiLSTM' AS model FROM documents
"""
