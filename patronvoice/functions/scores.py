"""Scores computed from columns of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronvoice.functions.numbers import round_half_even

NEUTRAL_THRESHOLD = 0.75


def neutral_threshold(label: Column, score: Column, threshold: float = NEUTRAL_THRESHOLD) -> Column:
    """Three classes out of two: a confidence below the threshold is neutral."""
    return (
        F.when(score < threshold, "neutral").when(label == "POSITIVE", "positive").otherwise("negative")
    )


def signed_score(sentiment: Column, confidence: Column) -> Column:
    return (
        F.when(sentiment == "positive", confidence)
        .when(sentiment == "negative", -confidence)
        .otherwise(F.lit(0.0))
    )


def popularity_score(c: Column) -> Column:
    return round_half_even(F.log1p(c.cast("double")), 3)


def has_reviews(c: Column) -> Column:
    return F.coalesce(c > 0, F.lit(False)).cast("int")


def complement_pct(a: Column, b: Column) -> Column:
    """What is left of 100, kept inside [0, 100]."""
    rest = F.lit(100.0) - a - b
    return F.when(rest.isNotNull(), round_half_even(F.greatest(F.least(rest, F.lit(100.0)), F.lit(0.0)), 1))


def rice_score(reach: Column, impact: Column, conf: Column, effort: Column) -> Column:
    """Reach x impact x confidence% / effort, rounded to an integer; null for zero effort."""
    raw = F.try_divide(reach * impact * conf / F.lit(100.0), effort)
    return round_half_even(raw).try_cast("bigint")
