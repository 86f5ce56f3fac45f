"""Steps on the listings table. Each one skips columns the table does not have."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.functions import (
    bin_cost_tier,
    bin_rating_tier,
    encode_yes_no,
    has_reviews,
    normalize_list_spacing,
    parse_count,
    parse_money,
    parse_rating,
    parse_reviews,
    popularity_score,
    primary_value,
    review_count,
    review_texts,
    strip_text,
    title_case_clean,
)
from patronvoice.operators.joins import compact_keys

# Column names of the raw listings and what fills their gaps.
RENAMES = {
    "approx_cost(for two people)": "approx_cost",
    "listed_in(type)": "listed_type",
    "listed_in(city)": "listed_city",
}
FILL_CONSTANTS = {
    "online_order": "No",
    "book_table": "No",
    "cuisines": "Unknown",
    "rest_type": "Unknown",
    "location": "Unknown",
    "listed_type": "Unknown",
    "listed_city": "Unknown",
    "reviews_list": "",
    "dish_liked": "",
    "menu_item": "",
    "phone": "",
    "address": "",
}
TITLE_COLUMNS = ("name", "location", "listed_type", "listed_city", "rest_type")


def normalize_column_names(df: DataFrame, renames: Mapping[str, str] = RENAMES) -> DataFrame:
    """Known long names first, then lower case and single underscores."""

    def tidy(name: str) -> str:
        name = renames.get(name, name)
        return re.sub(r"_+", "_", re.sub(r"\W", "_", name.strip().lower())).strip("_")

    return df.toDF(*[tidy(c) for c in df.columns])


def null_count_per_row(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def keep_most_complete(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the one with the fewest nulls; null keys count as one key.

    The smallest struct per key is an aggregate: rows of a hot key are reduced
    before the shuffle. Spark sorts for it, as structs are no hash aggregate's
    state, but no group is gathered. Ties are settled by
    all columns in name order. Exact copies fall away as well.
    """
    if key not in df.columns:
        return df
    others = sorted(c for c in df.columns if c != key)
    by_type = {f.name: f.dataType for f in df.schema.fields}
    # maps cannot be ordered, so their JSON form settles the tie
    order = [F.to_json(c) if isinstance(by_type[c], T.MapType) else F.col(c) for c in others]
    ranked = F.struct(null_count_per_row(df.columns).alias("_nulls"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    if any(isinstance(by_type[c], T.MapType) for c in others):
        kept = F.min_by(F.struct(*others), ranked).alias("kept")
        return df.groupBy(key).agg(kept).select(*[F.col(key) if c == key else F.col("kept")[c].alias(c) for c in df.columns])
    position = {c: f"o{i}" for i, c in enumerate(others)}
    kept = df.groupBy(key).agg(F.min(ranked).alias("kept"))
    return kept.select(*[F.col(key) if c == key else F.col("kept")[position[c]].alias(c) for c in df.columns])


def dedup_by_key(df: DataFrame, key: str = "url") -> DataFrame:
    return keep_most_complete(df, key)


def distinct_dup_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier combination of ``cols``."""
    cols = list(cols or df.columns)
    counts = compact_keys(df, cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def drop_null_identity(df: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    present = [k for k in keys if k in df.columns]
    return df.dropna(subset=present) if present else df


def missing_flag(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """1 where the raw value is null; to be called before parsing."""
    if col not in df.columns:
        return df
    return df.withColumn(name or f"{col}_missing", F.col(col).isNull().cast("int"))


def fill_missing(df: DataFrame, constants: Mapping[str, str] = FILL_CONSTANTS) -> DataFrame:
    present = {c: v for c, v in constants.items() if c in df.columns}
    return df.fillna(present) if present else df


def parse_numbers(df: DataFrame) -> DataFrame:
    parsers = {"rate": parse_rating, "votes": parse_count, "approx_cost": parse_money}
    return df.withColumns({c: p(F.col(c)) for c, p in parsers.items() if c in df.columns})


def round_cost_and_tier(df: DataFrame) -> DataFrame:
    """Whole currency units, and the tier of the imputed but not yet capped cost."""
    if "approx_cost" not in df.columns:
        return df
    cost = F.rint("approx_cost").try_cast("bigint")
    return df.withColumn("approx_cost", cost).withColumn("cost_tier", bin_cost_tier(F.col("approx_cost")))


def encode_binary_columns(df: DataFrame, cols: Sequence[str] = ("online_order", "book_table")) -> DataFrame:
    return df.withColumns({f"{c}_enc": encode_yes_no(F.col(c)) for c in cols if c in df.columns})


def clean_text_columns(df: DataFrame) -> DataFrame:
    out = {c: title_case_clean(F.col(c)) for c in TITLE_COLUMNS if c in df.columns}
    if "cuisines" in df.columns:
        out["cuisines"] = normalize_list_spacing(F.col("cuisines"))
    if "address" in df.columns:
        out["address"] = strip_text(F.col("address"))
    return df.withColumns(out) if out else df


def parse_reviews_column(df: DataFrame, col: str = "reviews_list", form: str = "literal") -> DataFrame:
    if col not in df.columns:
        return df
    return (
        df.withColumn(col, parse_reviews(F.col(col), form))
        .withColumn("review_texts", review_texts(F.col(col)))
        .withColumn("review_count", review_count(F.col("review_texts")))
    )


def derived_features(df: DataFrame) -> DataFrame:
    out = {}
    if "rate" in df.columns:
        out["rating_tier"] = bin_rating_tier(F.col("rate"))
    if "cuisines" in df.columns:
        out["primary_cuisine"] = primary_value(F.col("cuisines"))
    if "review_count" in df.columns:
        out["has_reviews"] = has_reviews(F.col("review_count"))
    if "votes" in df.columns:
        out["popularity_score"] = popularity_score(F.col("votes"))
    return df.withColumns(out) if out else df
