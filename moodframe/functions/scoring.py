"""Keyword scoring as integer-tenths column expressions.

Score of label e: ``t_e = 2 + sum(30 if keyword == e.lower() else 12)`` over the
label's keywords found as substrings of the cleaned text; ``score_e = t_e / T``
with ``T = sum(t_e)``.  Integers make argmax, tie order and the mixed-emotion
threshold exact (``score >= 0.15`` ⇔ ``20 * t_e >= 3 * T``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodframe.functions.constants import (
    BASE_TENTHS,
    EMOTIONS,
    KEYWORDS,
    MIXED_EMOTION_THRESHOLD,
    keyword_weight,
)

TENTH_COLS = [f"t_{e.lower()}" for e in EMOTIONS]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def label_tenths(cleaned: Column | str, emotion: str, lexicon: dict[str, list[str]] = KEYWORDS) -> Column:
    c = _c(cleaned)
    total = F.lit(BASE_TENTHS)
    for kw in lexicon.get(emotion, []):
        total = total + F.when(c.contains(kw), F.lit(keyword_weight(emotion, kw))).otherwise(F.lit(0))
    return total.cast("int")


def total_tenths(cols: list[str] = TENTH_COLS) -> Column:
    out = F.col(cols[0])
    for c in cols[1:]:
        out = out + F.col(c)
    return out


def argmax_label(cols: list[str] = TENTH_COLS, labels: list[str] = EMOTIONS) -> Column:
    """First label (in label order) holding the maximum."""
    top = F.greatest(*[F.col(c) for c in cols])
    expr = None
    for c, lab in zip(cols, labels):
        expr = F.when(F.col(c) == top, F.lit(lab)) if expr is None else expr.when(F.col(c) == top, F.lit(lab))
    return expr


def max_tenths(cols: list[str] = TENTH_COLS) -> Column:
    return F.greatest(*[F.col(c) for c in cols])


def sorted_label_array(cols: list[str] = TENTH_COLS, labels: list[str] = EMOTIONS) -> Column:
    """array<struct<neg, idx, emotion, tenths>> sorted by tenths desc, label order on ties."""
    items = [
        F.struct(
            (-F.col(c)).alias("neg"),
            F.lit(i).alias("idx"),
            F.lit(lab).alias("emotion"),
            F.col(c).alias("tenths"),
        )
        for i, (c, lab) in enumerate(zip(cols, labels))
    ]
    return F.array_sort(F.array(*items))


def threshold_fraction(threshold: float) -> tuple[int, int]:
    """``threshold`` as an exact fraction num/den (0.15 -> 3/20)."""
    from fractions import Fraction

    fr = Fraction(str(threshold)).limit_denominator(10**6)
    return fr.numerator, fr.denominator


def mixed_array(
    total: Column | str = "total_tenths",
    threshold: float = MIXED_EMOTION_THRESHOLD,
    cols: list[str] = TENTH_COLS,
) -> Column:
    """Mixed emotions: the top label always, the rest when score >= threshold."""
    num, den = threshold_fraction(threshold)
    tot = _c(total)
    return F.filter(
        sorted_label_array(cols),
        lambda x, i: (i == 0) | (x["tenths"] * den >= tot * num),
    )


def mixed_label(mixed: Column | str) -> Column:
    m = _c(mixed)
    return F.array_join(F.transform(m, lambda x: x["emotion"]), " + ")


def secondary_emotion(mixed: Column | str) -> Column:
    return F.try_element_at(_c(mixed), F.lit(2))["emotion"]


def scores_map(total: Column | str = "total_tenths", cols: list[str] = TENTH_COLS) -> Column:
    tot = _c(total).cast("double")
    return F.map_from_arrays(
        F.array(*[F.lit(e) for e in EMOTIONS]),
        F.array(*[F.col(c) / tot for c in cols]),
    )


# ---------------------------------------------------------------------------
# Probability-array forms (any scorer: keyword tenths, MLlib, external)
# ---------------------------------------------------------------------------


def probs_from_tenths(total: Column | str = "total_tenths", cols: list[str] = TENTH_COLS) -> Column:
    tot = _c(total).cast("double")
    return F.array(*[F.col(c) / tot for c in cols])


def argmax_from_probs(probs: Column | str, labels: list[str] = EMOTIONS) -> Column:
    """Label of the first maximum (``array_position`` returns the first match)."""
    p = _c(probs)
    pos = F.array_position(p, F.array_max(p))
    return F.element_at(F.array(*[F.lit(e) for e in labels]), pos.cast("int"))


def sorted_probs(probs: Column | str, labels: list[str] = EMOTIONS) -> Column:
    lab = F.array(*[F.lit(e) for e in labels])
    items = F.transform(
        _c(probs),
        lambda x, i: F.struct((-x).alias("neg"), i.alias("idx"), F.element_at(lab, i + 1).alias("emotion"), x.alias("score")),
    )
    return F.array_sort(items)


def mixed_from_probs(probs: Column | str, threshold: float = MIXED_EMOTION_THRESHOLD) -> Column:
    return F.filter(sorted_probs(probs), lambda x, i: (i == 0) | (x["score"] >= F.lit(threshold)))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def _divide_all(arr: Column, by: Column) -> Column:
    """arr / by element-wise.  ``by`` is passed as a repeated array rather than
    captured by the lambda: a captured expression is re-evaluated per element
    (higher-order functions run interpreted), which nests badly."""
    return F.zip_with(arr, F.array_repeat(by, F.size(arr)), lambda v, d: v / d)


def softmax(logits: Column | str) -> Column:
    """exp(x - max) / sum: stable softmax over an array column."""
    x = _c(logits).cast("array<double>")
    ex = F.zip_with(x, F.array_repeat(F.array_max(x), F.size(x)), lambda v, m: F.exp(v - m))
    return _divide_all(ex, _sum(ex))


def prob_repair(probs: Column | str, n: int = len(EMOTIONS)) -> Column:
    """Wrong length → repeat cyclically / truncate to n; divide by the sum;
    a zero sum gives the uniform distribution.  Empty/NULL input → NULL."""
    p = _c(probs).cast("array<double>")
    size = F.size(p)
    copies = F.ceil(F.lit(float(n)) / size).cast("int")
    resized = F.slice(F.flatten(F.array_repeat(p, copies)), 1, n)
    s = _sum(resized)
    uniform = F.array_repeat(F.lit(1.0 / n), n)
    return (
        F.when(p.isNull() | (size <= 0), F.lit(None).cast("array<double>"))
        .when(s != 0.0, _divide_all(resized, s))
        .otherwise(uniform)
    )
