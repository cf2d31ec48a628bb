"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to whole tables
and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm import alignment, ann, chat, langid, lm, mixing, neardup_text, neardup_vectors, packing, pii, quality, repair, toxicity
from moodframe.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nn_descent(spark, sf_dir):
    return neardup_vectors.near_duplicates(load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op2_minhash_bayes(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup_text.near_duplicates(docs)


@query
def op3_nb_svm(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out("doc_id", 5, 0)
    labels = load_table(spark, sf_dir, "labels").filter(~held)
    model = quality.fit(quality.with_labels(docs, labels, "doc_id", "quality", "text"), "id")
    return quality.score(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


@query
def op4_language_by_compression(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out("doc_id", 4, 2)
    dictionaries = langid.fit_dictionaries(docs.filter(~held))
    return langid.identify(docs.select("doc_id", "text", held.alias("held_out")), dictionaries, keep=["doc_id", "held_out"])


@query
def op5_pruned_graph_search(spark, sf_dir):
    vectors = ann.usable(load_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@query
def op6_semicrf_pii(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_pii(docs, pii.fit(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


@query
def op7_attention_lm(spark, sf_dir):
    import public_tokenizers

    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_corpus(docs, langid.held_out("doc_id", 10, 0), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op8_shortest_pack_first(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


@query
def op9_pivotal_mixing(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.taken(mixing.mix_sources(docs))


@query
def op10_chat_format(spark, sf_dir):
    turns = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.digests(chat.format_chat(turns.unionByName(more)))


@query
def op11_galloping_alignment(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


@query
def op12_toxic_spans(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = langid.held_out("doc_id", 5, 0)
    labels = load_table(spark, sf_dir, "labels").filter(~held)
    model = toxicity.fit(quality.with_labels(docs, labels, "doc_id", "toxic", "text"), "id")
    return toxicity.score(docs.select("doc_id", "text", held.alias("held_out")), model, keep=["doc_id", "held_out"])


@query
def op13_structure_repair(spark, sf_dir):
    turns = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair(repair.damage(turns), ids=turns.select("conv_id"))


# formatted_chars counts template characters: 11 + 11 + 7 around the role of each run of
# one role, 8 between turns, one backslash for each control string in a role or text.
ORACLE["op10_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS k,
    coalesce(lag(role) OVER w <> role, true) AS opens
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
sized AS (
  SELECT *,
    length(text) + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|<SYS>|</SYS>|/?INST\])')) AS text_chars,
    CASE WHEN opens THEN 27 + length(role) + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|<SYS>|</SYS>|/?INST\])')) ELSE 8 END AS mark_chars
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + mark_chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_REACH = """
walk(id, other) AS (
  SELECT a, b FROM links UNION SELECT w.id, l.b FROM walk w JOIN links l ON l.a = w.other),
low AS (SELECT id, min(other) AS least_id FROM walk GROUP BY id)
"""

ORACLE["op1_nn_descent"] = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM u p, u q
  WHERE p.vec_id <> q.vec_id AND list_inner_product(p.e, q.e) / (p.norm * q.norm) >= 0.9),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(low.least_id, e.vec_id)) AS component_id,
  e.vec_id <= coalesce(low.least_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.id = e.vec_id
"""

ORACLE["op2_minhash_bayes"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w),
one AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM one p JOIN one q ON q.shingle = p.shingle AND q.doc_id <> p.doc_id GROUP BY 1, 2),
links AS (
  SELECT c.a, c.b FROM common c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b
  WHERE 100 * c.n >= 75 * (len(x.shingles) + len(y.shingles) - c.n)),
{_REACH}
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(low.least_id, s.doc_id)) AS component_id,
  s.doc_id <= coalesce(low.least_id, s.doc_id) AS kept
FROM s LEFT JOIN low ON low.id = s.doc_id
"""

# Each step of the recursion takes one row of every conversation and keeps, for each
# state, the cheapest edits so far (ties: least in ASCII).
ORACLE["op13_structure_repair"] = r"""
WITH RECURSIVE byte AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(i AS BIGINT)) AS c FROM range(256) t(i))),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
fated AS (
  SELECT k.*, xor(list_reduce(list_transform(range(1, length(key) + 1), lambda i: CAST(ord(key[i]) AS BIGINT)),
    lambda c, b: xor(c >> 8, byte.crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS fate
  FROM keyed k, byte),
spoiled AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM spoiled),
marked AS (
  SELECT *, said = '' AS blank,
    said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS repeated,
    right(said, 1) NOT IN ('.', '!', '?') AS open_end,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
summed AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE repeated) AS duplicate,
    count(*) FILTER (WHERE NOT blank AND NOT repeated AND open_end) AS truncated,
    count(*) FILTER (WHERE n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_rows
  FROM marked GROUP BY conv_id),
edit(e, worth, f, t, initial) AS (VALUES
  ('D', 2, 0, 0, ''), ('D', 2, 1, 1, ''), ('D', 2, 2, 2, ''), ('D', 2, 3, 3, ''),
  ('R', 1, 0, 2, ''), ('R', 1, 1, 2, ''), ('R', 1, 2, 3, ''), ('R', 1, 3, 2, ''),
  ('K', 0, 0, 1, 's'), ('K', 0, 0, 2, 'u'), ('K', 0, 1, 2, 'u'), ('K', 0, 2, 3, 'a'), ('K', 0, 3, 2, 'u')),
put(i, worth, f, t) AS (VALUES
  ('', 0, 0, 0), ('', 0, 1, 1), ('', 0, 2, 2), ('', 0, 3, 3), ('I', 5, 0, 2), ('I', 5, 1, 2), ('I', 5, 2, 3), ('I', 5, 3, 2), ('II', 10, 0, 3), ('II', 10, 1, 3)),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM summed
  UNION ALL
  SELECT conv_id, n, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT w.conv_id, w.n + 1 AS n, e.t AS state, w.cost + p.worth + e.worth + CASE WHEN m.open_end AND e.e <> 'D' THEN 5 ELSE 0 END AS cost, w.audit || p.i || e.e AS audit
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n + 1
      JOIN put p ON p.f = w.state
      JOIN edit e ON e.f = p.t AND (e.e <> 'K' OR e.initial = m.initial) AND (e.e = 'D' OR NOT (m.blank OR m.repeated))) c
  GROUP BY conv_id, n, state),
closed AS (
  SELECT w.conv_id, min(cost + 5 * more) AS cost, arg_min(audit || repeat('I', more), (cost + 5 * more, audit || repeat('I', more))) AS audit
  FROM (SELECT *, CASE state WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS more FROM walk) w
    JOIN summed s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n_rows = w.n GROUP BY w.conv_id),
step AS (
  SELECT conv_id, audit, k, audit[k] AS e, length(replace(audit[1:k], 'I', '')) AS n
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM closed) c),
-- after a system row or none the user is due, then turn about: legal rows alternate
kept AS (
  SELECT s.conv_id, s.k, CASE WHEN s.e = 'I' THEN '' ELSE m.text END AS text,
    CASE WHEN s.e = 'K' THEN m.role END AS own, s.e = 'K' AND m.initial = 's' AS system
  FROM step s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.n = s.n AND s.e <> 'I' WHERE s.e <> 'D'),
named AS (
  SELECT conv_id, k, text, coalesce(own, CASE WHEN sum(CASE WHEN system THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS role FROM kept),
joined AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY k) AS lines FROM named GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(coalesce(c.cost, 0) AS BIGINT) AS cost,
  coalesce(c.audit, '') AS audit, sha256(coalesce(j.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
  LEFT JOIN summed s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN closed c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
  LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM i.conv_id
"""
