"""Sources and sinks: tables derived from the driver tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.session import ensure_checkpoint_dir
from patronvoice.sources.readers import NULL_TOKENS, RAW_COLUMNS, read_cleaned, read_raw_listings, read_sentiment
from patronvoice.sources.writers import write_table
from registry.base import register

_TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def _written(spark: SparkSession, df: DataFrame, fmt: str) -> str:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/files/{uuid.uuid4().hex}"
    write_table(df, path, fmt)
    return path


@register(
    "read_raw_listings",
    "SELECT " + ", ".join(f'CASE WHEN "{c}" NOT IN ({_TOKENS}) THEN "{c}" END AS "{c}"' for c in RAW_COLUMNS) + " FROM raw",
    "raw",
)
def _(t):
    path = _written(t.spark, t.raw.select(*[F.col(f"`{c}`") for c in RAW_COLUMNS]), "csv")
    return read_raw_listings(t.spark, path, columns=RAW_COLUMNS)


def _nested(t):
    texts = F.array(F.concat(F.lit('say "'), F.col("name"), F.lit('"')), F.lit("a,b\nc"))
    return t.ent.select("name", "rate", "approx_cost", F.col("url").alias("votes"), texts.alias("review_texts"))


_NESTED_SQL = (
    "SELECT name, rate, CAST(url AS DOUBLE) AS votes, CAST(approx_cost AS DOUBLE) AS approx_cost, "
    "concat('say \"', name, '\"|a,b', chr(10), 'c') AS review_texts FROM ent"
)


def _flat(df: DataFrame) -> DataFrame:
    numbers = {c: F.col(c).cast("double") for c in ("votes", "approx_cost")}
    return df.withColumns(numbers | {"review_texts": F.array_join("review_texts", "|")})


@register("read_cleaned", _NESTED_SQL, "ent")
def _(t):
    return _flat(read_cleaned(t.spark, _written(t.spark, _nested(t), "csv"), fmt="csv"))


@register("read_sentiment", _NESTED_SQL, "ent")
def _(t):
    return _flat(read_sentiment(t.spark, _written(t.spark, _nested(t), "parquet")))


@register("write_table", _NESTED_SQL, "ent")
def _(t):
    source = _nested(t)
    return _flat(t.spark.read.schema(source.schema).json(_written(t.spark, source, "json")))
