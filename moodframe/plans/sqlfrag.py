"""SQL fragments for the DuckDB oracle.

These restate the cleaning and scoring rules in DuckDB's dialect so each
Spark query can be checked against an independent engine.  They are built
from the same fixed values in ``moodframe.functions.constants``.
"""

from __future__ import annotations

from moodframe.functions.constants import (
    ACADEMIC_FIELDS,
    BASE_TENTHS,
    CONTRACTIONS,
    EMOTIONS,
    KEYWORDS,
    ROLES,
    keyword_weight,
)
from moodframe.functions.text import NON_WORD_PATTERN, PUNCT_PATTERN, URL_PATTERN
from moodframe.sources.views import PHRASES

TENTH_COLS = [f"t_{e.lower()}" for e in EMOTIONS]
MODEL_CHOICES = ["bert", "bilstm", "compare"]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean_sql(col: str) -> str:
    out = f"lower({col})"
    for short, long in CONTRACTIONS:
        out = f"replace({out}, {q(short)}, {q(long)})"
    out = f"regexp_replace({out}, {q(URL_PATTERN)}, ' ', 'g')"
    out = f"regexp_replace({out}, {q(PUNCT_PATTERN)}, '', 'g')"
    out = f"regexp_replace({out}, {q(NON_WORD_PATTERN)}, ' ', 'g')"
    return f"trim({out})"


def tenths_sql(col: str) -> str:
    parts = []
    for e, name in zip(EMOTIONS, TENTH_COLS):
        terms = " + ".join(
            f"(CASE WHEN contains({col}, {q(kw)}) THEN {keyword_weight(e, kw)} ELSE 0 END)" for kw in KEYWORDS[e]
        )
        parts.append(f"CAST({BASE_TENTHS} + {terms} AS INTEGER) AS {name}")
    return ", ".join(parts)


def total_sql() -> str:
    return " + ".join(TENTH_COLS)


def argmax_sql() -> str:
    top = f"greatest({', '.join(TENTH_COLS)})"
    whens = " ".join(f"WHEN {c} = {top} THEN {q(e)}" for c, e in zip(TENTH_COLS, EMOTIONS))
    return f"CASE {whens} END"


def max_sql() -> str:
    return f"greatest({', '.join(TENTH_COLS)})"


def pick_sql(values: list[str], index_expr: str) -> str:
    """values[index] with a 0-based index."""
    return f"([{', '.join(q(v) for v in values)}])[({index_expr}) + 1]"


def scored_cte(src: str, keys: list[str], text_col: str = "text") -> str:
    """CTE body: keys, cleaned_text, tenths, total_tenths, emotion, confidence."""
    k = ", ".join(keys)
    return f"""
    (SELECT *, {argmax_sql()} AS emotion,
            CAST({max_sql()} AS DOUBLE) / total_tenths AS confidence
     FROM (SELECT *, {total_sql()} AS total_tenths
           FROM (SELECT {k}, cleaned_text, {tenths_sql('cleaned_text')}
                 FROM (SELECT {k}, {clean_sql(text_col)} AS cleaned_text FROM {src}) c0) c1) c2)
    """


def unpivot_sql(src: str, keys: list[str]) -> str:
    """(keys, label_id, emotion, tenths, total_tenths) long form of a scored relation."""
    k = ", ".join(keys)
    arms = [
        f"SELECT {k}, {i} AS label_id, {q(e)} AS emotion, {c} AS tenths, total_tenths FROM {src}"
        for i, (e, c) in enumerate(zip(EMOTIONS, TENTH_COLS))
    ]
    return "(" + " UNION ALL ".join(arms) + ")"


# Views of moodframe.sources.views, restated.

LABELLED_VIEW = f"""
    (SELECT doc_id AS row_id, text,
        CASE (doc_id % 11)
          WHEN 1 THEN lower({pick_sql(EMOTIONS, 'doc_id % 7')})
          WHEN 2 THEN ' ' || {pick_sql(EMOTIONS, 'doc_id % 7')} || chr(9)
          WHEN 3 THEN 'Bored'
          WHEN 4 THEN NULL
          WHEN 5 THEN 'NA'
          ELSE {pick_sql(EMOTIONS, 'doc_id % 7')} END AS emotion
     FROM documents)
"""

SUBMISSIONS_VIEW = f"""
    (SELECT e.event_id AS seq, e.ts, d.doc_id,
        ' user' || CAST(e.user_id AS VARCHAR) || '@example.com ' AS email,
        CASE WHEN e.event_id % 13 = 0 THEN NULL
             WHEN e.event_id % 17 = 0 THEN '   '
             ELSE '  User ' || CAST(e.user_id AS VARCHAR) END AS name,
        {pick_sql(ROLES, '(e.event_id + e.user_id) % 3')} AS role,
        {pick_sql(ACADEMIC_FIELDS, 'e.event_id % 11')} AS field,
        CASE WHEN e.event_id % 53 = 0 THEN ' ' || chr(9) || ' ' ELSE d.text END AS text,
        {pick_sql(MODEL_CHOICES, 'e.event_id % 3')} AS model_choice,
        (e.event_id % 10 <> 0) AS save
     FROM events e
     JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))
"""

PHRASES_VIEW = f"""
    (SELECT conv_id, turn, concat_ws(' ', text, {pick_sql(PHRASES, f'(conv_id + turn) % {len(PHRASES)}')}) AS text FROM conversations)
"""
