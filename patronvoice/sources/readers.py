"""Table readers."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.functions import coerce_numeric, null_tokens_to_null

# Columns of the raw listings file and the texts that mean null.
RAW_COLUMNS = (
    "url",
    "address",
    "name",
    "online_order",
    "book_table",
    "rate",
    "votes",
    "phone",
    "location",
    "rest_type",
    "dish_liked",
    "cuisines",
    "approx_cost(for two people)",
    "reviews_list",
    "menu_item",
    "listed_in(type)",
    "listed_in(city)",
)
NULL_TOKENS = (
    "",
    "nan",
    "NaN",
    "NULL",
    "null",
    "N/A",
    "n/a",
    "NA",
    "None",
    "<NA>",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-nan",
    "-NaN",
    "1.#IND",
    "1.#QNAN",
    "-1.#IND",
    "-1.#QNAN",
)


def normalize_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn the tokens into null in every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_tokens_to_null(F.col(f"`{c}`"), tokens) for c in strings})


def read_raw_listings(
    spark: SparkSession,
    path: str,
    null_tokens: Sequence[str] = NULL_TOKENS,
    columns: Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """CSV as text columns, nothing cast, null tokens normalised.

    The header names the columns unless ``columns`` does. A file whose quoted
    values hold line breaks cannot be split among tasks; give many files, or
    ``multi_line=False`` where no value spans lines.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return normalize_nulls(reader.csv(path), null_tokens)


def ensure_array_column(df: DataFrame, col: str) -> DataFrame:
    """Add an empty array column where it is absent."""
    return df if col in df.columns else df.withColumn(col, F.array().cast("array<string>"))


def spread_small_input(df: DataFrame, *by: str) -> DataFrame:
    """Give every core rows of a table that arrives in fewer tasks than there are cores.

    Only for input that feeds costly work per row. A large table has more splits
    than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def _restore(df: DataFrame, numeric_cols: Sequence[str], list_col: str) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in numeric_cols if isinstance(types.get(c), T.StringType)]
    df = df.withColumns({c: coerce_numeric(F.col(c)) for c in text})
    if isinstance(types.get(list_col), T.StringType):
        texts = F.from_json(list_col, "array<string>")
        df = df.withColumn(list_col, F.coalesce(texts, F.array().cast("array<string>")))
    return ensure_array_column(df, list_col)


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt == "csv":
        return read_raw_listings(spark, path)
    return spark.read.format(fmt).load(path)


def read_cleaned(
    spark: SparkSession,
    path: str,
    numeric_cols: Sequence[str] = ("rate", "votes", "approx_cost", "review_count"),
    list_col: str = "review_texts",
    fmt: str = "parquet",
) -> DataFrame:
    """The cleaned table; in flat formats numbers and the list column are restored."""
    return _restore(_read(spark, path, fmt), numeric_cols, list_col)


def read_sentiment(
    spark: SparkSession,
    path: str,
    numeric_cols: Sequence[str] = (
        "rate",
        "votes",
        "approx_cost",
        "review_count",
        "avg_signed_score",
        "sentiment_negative_pct",
    ),
    list_col: str = "review_texts",
    fmt: str = "parquet",
) -> DataFrame:
    return _restore(_read(spark, path, fmt), numeric_cols, list_col)


def cap_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def read_serving_tables(
    spark: SparkSession, folder: str, review_cap: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, topics, review topics); a missing table is replaced by generated data.

    ``review_cap`` bounds the review table, ordered by all of its columns.
    """
    from patronvoice.sources.synthetic import demo_topics, synthesize_listings, synthesize_reviews

    def load(name: str, otherwise):
        try:
            return spark.read.parquet(os.path.join(folder, name))
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return otherwise()

    entities = load("entities", lambda: synthesize_listings(spark, 5000, seed))
    topics = load("topics", lambda: demo_topics(spark))
    reviews = load("review_topics", lambda: synthesize_reviews(spark, 3000, seed=seed))
    if review_cap is not None:
        reviews = reviews.orderBy(*reviews.columns).limit(review_cap)
    return entities, topics, reviews
