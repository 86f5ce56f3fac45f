"""Binning. Intervals are open on the left and closed on the right."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")

# Interval edges and labels.
COST_TIERS = ([0, 300, 600, 1000, 2000, _INF], ["budget", "low-mid", "mid", "premium", "luxury"])
RATING_TIERS = ([0, 3.0, 3.5, 4.0, 5.0], ["low", "average", "good", "excellent"])
RATING_STARS = (
    [1.0, 2.0, 3.0, 3.5, 4.0, 5.0],
    ["1-2 stars", "2-3 stars", "3-3.5 stars", "3.5-4 stars", "4-5 stars"],
)


def cut_right_closed(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]`` holding the value; null outside."""
    inside = (c > edges[0]) if edges[-1] == _INF else (c > edges[0]) & (c <= edges[-1])
    chain = F.when(~inside, F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(F.lit(True) & c.isNotNull() if upper == _INF else c <= upper, label)
    return chain


def bin_cost_tier(c: Column) -> Column:
    return cut_right_closed(c, *COST_TIERS)


def bin_rating_tier(c: Column) -> Column:
    return cut_right_closed(c, *RATING_TIERS)


def bin_rating_star(c: Column) -> Column:
    """Exactly one star falls outside the first interval and is null."""
    return cut_right_closed(c, *RATING_STARS)


def equal_width_bin(c: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based histogram bin; left-closed, only the last one also right-closed.

    The division can land one bin off next to an edge, so the guess is compared
    with the edges themselves.
    """
    width = (hi - lo) / bins

    def edge(i: Column) -> Column:
        return F.lit(float(lo)) + i.cast("double") * F.lit(width)

    guess = F.least(F.floor((c - F.lit(float(lo))) / F.lit(width)).cast("int"), F.lit(bins - 1))
    fixed = (
        F.when(c < edge(guess), guess - 1)
        .when((guess < bins - 1) & (c >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    return F.when(c.between(lo, hi), fixed)
