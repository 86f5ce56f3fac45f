"""Arrays, maps and the review-list literal."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.functions.numbers import round_half_even
from patronvoice.functions.text import unescape_newline

REVIEWS_TYPE = T.ArrayType(
    T.StructType([T.StructField("rating", T.StringType()), T.StructField("text", T.StringType())])
)


def _pairs(literal: str | None) -> list[dict]:
    if not literal:
        return []
    try:
        parsed = ast.literal_eval(literal)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return []
    if not isinstance(parsed, list):
        return []
    return [
        {"rating": str(item[0]), "text": str(item[1])}
        for item in parsed
        if isinstance(item, (list, tuple)) and len(item) >= 2
    ]


@F.pandas_udf(REVIEWS_TYPE)
def _parse_literals(raw: pd.Series) -> pd.Series:
    return raw.map(_pairs)


def parse_reviews(c: Column, form: str = "literal") -> Column:
    """Text to an array of (rating, text); malformed or missing text gives an empty array.

    ``literal`` reads Python list-of-tuples text, whose quoting has no equivalent
    among Spark's functions, in Arrow batches. ``json`` reads an array of objects
    with ``from_json`` and stays in the JVM.
    """
    if form == "json":
        return F.coalesce(F.from_json(c, REVIEWS_TYPE), F.array().cast(REVIEWS_TYPE))
    if form != "literal":
        raise ValueError(f"form must be literal or json, not {form!r}")
    return _parse_literals(F.trim(c))


def review_texts(reviews: Column) -> Column:
    """The texts worth reading: unescaped, stripped, neither blank nor ``nan``."""
    texts = F.transform(reviews, lambda r: unescape_newline(r["text"]))
    return F.filter(texts, lambda t: (t != "") & (F.lower(t) != "nan"))


def review_count(texts: Column) -> Column:
    return F.coalesce(F.size(texts), F.lit(0))


def keyword_weight_map(words: Column, weights: Column, k: int = 10) -> Column:
    """word -> weight (4 decimals) of the first ``k``."""
    pairs = F.zip_with(words, weights, lambda w, s: F.struct(w, round_half_even(s, 4)))
    return F.map_from_entries(F.slice(pairs, 1, k))


def map_items_top(c: Column, k: int = 8) -> Column:
    """First ``k`` entries of a map as array of (key, value)."""
    return F.slice(F.map_entries(c), 1, k)


def stringify_nested(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nested columns as JSON text, for flat formats such as CSV."""
    nested = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) and (cols is None or f.name in cols)
    ]
    return df.withColumns({name: F.to_json(name) for name in nested}) if nested else df
