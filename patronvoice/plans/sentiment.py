"""Clean entities to scored reviews and entities with sentiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronvoice.functions.scores import NEUTRAL_THRESHOLD
from patronvoice.operators.scorers import Scorer, score_sentiment
from patronvoice.operators.sentiment import (
    attach_sentiment,
    entity_sentiment,
    explode_reviews,
    fill_defaults_after_join,
    sentiment_summary,
)
from patronvoice.sources.readers import read_cleaned
from patronvoice.sources.writers import write_table


def review_sentiment(
    entities: DataFrame,
    scorer: Scorer,
    key: str = "url",
    list_col: str = "review_texts",
    threshold: float = NEUTRAL_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """(entities with sentiment, scored reviews)."""
    reviews = score_sentiment(explode_reviews(entities, key, list_col), "review_text", scorer, threshold)
    return entities_with_sentiment(entities, reviews, key), reviews


def entities_with_sentiment(entities: DataFrame, reviews: DataFrame, key: str = "url") -> DataFrame:
    return fill_defaults_after_join(attach_sentiment(entities, entity_sentiment(reviews, key), key))


def run_sentiment(spark: SparkSession, cleaned_path: str, out_dir: str, scorer: Scorer, key: str = "url") -> DataFrame:
    """Scored reviews are written first, so that scoring is paid once."""
    entities = read_cleaned(spark, cleaned_path)
    _, reviews = review_sentiment(entities, scorer, key)
    write_table(reviews, f"{out_dir}/reviews")
    reviews = spark.read.parquet(f"{out_dir}/reviews")
    write_table(entities_with_sentiment(entities, reviews, key), f"{out_dir}/sentiment")
    result = spark.read.parquet(f"{out_dir}/sentiment")
    write_table(sentiment_summary(result), f"{out_dir}/sentiment_summary", "json")
    return result
