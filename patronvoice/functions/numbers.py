"""Messy text to numbers. Unparsable input is null, never NaN and never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronvoice.functions.text import SPACE, strip_text

_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Scale, round to the even neighbour, scale back (null stays null)."""
    if digits == 0:
        return F.rint(c)
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def coerce_numeric(c: Column) -> Column:
    """String to double; the pattern guard rejects 'NaN', 'inf' and '12d'."""
    text = strip_text(c.cast("string"))
    number = F.when(text.rlike(_NUMERIC), text).try_cast("double")
    # 1e999 parses to infinity
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def range_to_null(c: Column, lo: float, hi: float) -> Column:
    """Keep values inside [lo, hi], null the rest."""
    return F.when(c.between(lo, hi), c)


def negative_to_null(c: Column, inclusive: bool = False) -> Column:
    """Null values below zero; with ``inclusive`` zero goes as well."""
    return F.when(c > 0 if inclusive else c >= 0, c)


def parse_rating(c: Column, lo: float = 1.0, hi: float = 5.0) -> Column:
    """First number in the text (``4.1/5``) when it lies in [lo, hi], one decimal."""
    first = F.regexp_extract(c, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    return round_half_even(range_to_null(first, lo, hi), 1)


def parse_count(c: Column) -> Column:
    """``1,234`` to bigint; negative and fractional values are null."""
    number = negative_to_null(coerce_numeric(F.replace(c, F.lit(","), F.lit(""))))
    return F.when(number == F.floor(number), number).try_cast("bigint")


def parse_money(c: Column) -> Column:
    """Drop commas, the rupee sign and whitespace; zero and below is null."""
    return negative_to_null(coerce_numeric(F.regexp_replace(c, f"[,₹{SPACE}]", "")), inclusive=True)
