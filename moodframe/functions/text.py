"""Text cleaning and tokenising as Spark column expressions.

All of it stays JVM-side (regexp_replace / replace / split / higher-order
functions), so it runs inside whole-stage codegen and never crosses into
Python.  The same cleaning rules are restated for DuckDB in
``moodframe.plans.sqlfrag`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodframe.functions.constants import CONTRACTIONS

# The Unicode whitespace set of Python's ``str.isspace`` / ``re`` ``\s``.
# Java's ``\s`` is ASCII-only, so URL matching spells the class out.
WS_CLASS = (
    r"\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = rf"https?://[^{WS_CLASS}]+|www\.[^{WS_CLASS}]+"
# The 32 ASCII punctuation characters: deleted, not spaced.
PUNCT_PATTERN = r"[!-/:-@\[-`{-~]"
PUNCT_CHARS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
# Anything left that is not a lowercase ASCII letter or digit separates words.
NON_WORD_PATTERN = r"[^a-z0-9]+"
WS_RUN_PATTERN = rf"^[{WS_CLASS}]+|[{WS_CLASS}]+$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_ws(col: Column | str) -> Column:
    """Strip Unicode whitespace at both ends (Spark ``trim`` strips only U+0020)."""
    return F.regexp_replace(_c(col), WS_RUN_PATTERN, "")


def expand_contractions(col: Column | str) -> Column:
    """Literal replacements, in the fixed order (``can't`` before ``n't`` before ``'t``).

    A replace that finds nothing returns its input without copying, so texts
    without apostrophes cost ten substring scans.  (No ``when`` guard here: a
    guard would reference the input expression several times and the nested
    cleaning expression would grow multiplicatively.)"""
    out = _c(col)
    for short, long in CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(long))
    return out


def strip_urls(col: Column | str) -> Column:
    """URLs → one space."""
    return F.regexp_replace(_c(col), URL_PATTERN, " ")


def basic_clean(col: Column | str) -> Column:
    """lower → contractions → URLs → delete punctuation → non-words to one space → trim.

    Astral characters need no step of their own: they are not ``[a-z0-9]``
    and so become separators like any other symbol.  NULL stays NULL.
    """
    out = F.lower(_c(col))
    out = expand_contractions(out)
    out = strip_urls(out)
    out = F.translate(out, PUNCT_CHARS, "")  # delete punctuation (char map, no regex)
    out = F.regexp_replace(out, NON_WORD_PATTERN, " ")
    return F.trim(out)


def tokenize(cleaned: Column | str) -> Column:
    """Tokens of cleaned text (single-spaced, trimmed); empty text gives an
    empty array rather than ``['']``.  The text is read once, and without a
    lambda: higher-order functions run interpreted."""
    return F.array_remove(F.split(_c(cleaned), " "), "")


def lemmatize_tokens(df: DataFrame, key: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """Replace each token of ``tokens_col`` by its lemma from a (surface, lemma)
    table with one row per surface; unknown tokens and all other columns stay.

    Only a row's distinct tokens are exploded, and only those that the table
    changes come out of the join: a row's changes meet again as a small map.
    A word that stands in nearly every row is thus met once per row, and its
    join partition is an ordinary sort-merge one that AQE can split.  ``df``
    is read twice: pass a written table.
    """
    each = df.select(key, F.explode_outer(F.array_distinct(tokens_col)).alias("_tok"))
    lem = lemmas.select(F.col("surface").alias("_tok"), F.col("lemma").alias("_lemma")).filter("_tok <> _lemma").dropDuplicates(["_tok"])
    changes = each.join(lem, "_tok").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_tok", "_lemma"))).alias("_map"))
    new = F.transform(tokens_col, lambda t: F.coalesce(F.col("_map")[t], t))
    out = df.join(changes, key, "left").withColumn(tokens_col, F.when(F.col("_map").isNull(), F.col(tokens_col)).otherwise(new))
    return out.select(*df.columns)


def iso_seconds(ts: Column | str) -> Column:
    """Timestamp as ISO text to whole seconds (fraction truncated)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def percent(col: Column | str) -> Column:
    """0.4567 → '45.7%' (formatting at the edge only; tables keep doubles)."""
    return F.format_string("%.1f%%", _c(col) * 100)
