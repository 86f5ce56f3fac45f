"""Review search: a predicate scan with highlighted hits and figures about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.functions import highlight_matches
from patronvoice.functions import search_predicate as text_matches
from patronvoice.operators.breakdowns import value_counts


def search_hits(
    reviews: DataFrame, query: str = "", topic: str | None = None, sentiment: str | None = None, mode: str = "regex"
) -> DataFrame:
    """All reviews that match; empty choices keep everything."""
    hits = reviews
    if query:
        hits = hits.where(text_matches(F.col("review_text"), query, mode))
    if topic is not None:
        hits = hits.where(F.col("topic_label") == topic)
    if sentiment is not None:
        hits = hits.where(F.col("sentiment") == sentiment)
    return hits


def search_reviews(
    reviews: DataFrame,
    query: str = "",
    topic: str | None = None,
    sentiment: str | None = None,
    n: int | None = 50,
    mode: str = "regex",
    key: str = "review_id",
) -> DataFrame:
    """The first n hits by key, matches wrapped in ``<mark>``."""
    hits = search_hits(reviews, query, topic, sentiment, mode)
    if n is not None:
        hits = hits.orderBy(key).limit(n)
    return hits.withColumn("highlighted", highlight_matches(F.col("review_text"), query, mode))


def search_stats(hits: DataFrame) -> DataFrame:
    """One row: hits, % positive, % negative, distinct topics."""
    per_topic = hits.groupBy("topic_label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sentiment") == "positive").alias("pos"),
        F.count_if(F.col("sentiment") == "negative").alias("neg"),
    )
    return per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("results"),
        F.try_divide(F.sum("pos"), F.sum("n") / 100).alias("positive_pct"),
        F.try_divide(F.sum("neg"), F.sum("n") / 100).alias("negative_pct"),
        F.count("topic_label").alias("topics"),
    )


def search_topic_breakdown(hits: DataFrame, min_hits: int = 5) -> DataFrame:
    """Hits per topic; empty when there are fewer than ``min_hits``."""
    enough = hits.agg(F.count(F.lit(1)) >= min_hits).scalar()
    return value_counts(hits, "topic_label").where(enough)
