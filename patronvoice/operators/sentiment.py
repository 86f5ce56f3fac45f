"""Per-review sentiment and its aggregation per entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.functions import neutral_threshold, round_half_even, signed_score, strip_text
from patronvoice.functions.scores import NEUTRAL_THRESHOLD
from patronvoice.operators.joins import lookup_join

CLASSES = ("positive", "negative", "neutral")

# What an entity without reviews gets.
NO_REVIEW_DEFAULTS = {
    "total_reviews": 0,
    "positive_count": 0,
    "negative_count": 0,
    "neutral_count": 0,
    "sentiment_positive_pct": 0.0,
    "sentiment_negative_pct": 0.0,
    "sentiment_neutral_pct": 0.0,
    "avg_signed_score": 0.0,
    "sentiment_volatility": 0.0,
    "dominant_sentiment": "neutral",
}


def non_blank_text(df: DataFrame, col: str, drop_nan: bool = False) -> DataFrame:
    keep = strip_text(F.col(col)) != ""
    if drop_nan:
        keep = keep & (F.lower(strip_text(F.col(col))) != "nan")
    return df.where(keep)


def explode_reviews(
    df: DataFrame, key: str = "url", list_col: str = "review_texts", carry: Sequence[str] = ("name",)
) -> DataFrame:
    """One row per non-blank text: key, carried columns, position in the list, text."""
    carried = [c for c in carry if c in df.columns]
    rows = df.select(*carried, key, F.posexplode(list_col).alias("review_pos", "review_text"))
    return non_blank_text(rows, "review_text")


def add_sentiment(reviews: DataFrame, label: str = "raw_label", score: str = "score", threshold: float = NEUTRAL_THRESHOLD) -> DataFrame:
    """Class, rounded confidence and signed score from a model's label and score.

    The threshold is tested on the unrounded score.
    """
    return (
        reviews.withColumn("sentiment", neutral_threshold(F.col(label), F.col(score), threshold))
        .withColumn("confidence", round_half_even(F.col(score), 4))
        .withColumn("signed_score", signed_score(F.col("sentiment"), F.col("confidence")))
    )


def sentiment_by_entity(reviews: DataFrame, key: str = "url") -> DataFrame:
    """Counts per class, mean and sample deviation of the signed score.

    Every aggregate combines before the shuffle, so an entity holding a third of
    the reviews arrives as one row per map task.
    """
    counts = [F.count_if(F.col("sentiment") == c).alias(f"{c}_count") for c in CLASSES]
    return (
        reviews.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("sentiment").alias("total_reviews"),
            *counts,
            F.avg("signed_score").alias("avg_signed_score"),
            F.coalesce(F.stddev_samp("signed_score"), F.lit(0.0)).alias("sentiment_volatility"),
        )
    )


def class_percentages(agg: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    # ratio first, then times 100: the order decides which halves round up
    pct = {
        f"sentiment_{c}_pct": round_half_even(F.try_divide(F.col(f"{c}_count"), F.col("total_reviews")) * 100, 1)
        for c in classes
    }
    return agg.withColumns(pct)


def dominant_sentiment(agg: DataFrame) -> DataFrame:
    """Largest class; ties go to positive, then negative."""
    pos, neg, neu = (F.col(f"{c}_count") for c in CLASSES)
    winner = F.when((pos >= neg) & (pos >= neu), "positive").when(neg >= neu, "negative").otherwise("neutral")
    return agg.withColumn("dominant_sentiment", winner)


def entity_sentiment(reviews: DataFrame, key: str = "url") -> DataFrame:
    return (
        sentiment_by_entity(reviews, key)
        .transform(class_percentages)
        .transform(dominant_sentiment)
        .withColumn("avg_signed_score", round_half_even(F.col("avg_signed_score"), 4))
    )


def attach_sentiment(entities: DataFrame, agg: DataFrame, key: str = "url") -> DataFrame:
    return lookup_join(entities, agg, [key])


def fill_defaults_after_join(df: DataFrame, defaults: Mapping[str, object] = NO_REVIEW_DEFAULTS) -> DataFrame:
    return df.fillna({c: v for c, v in defaults.items() if c in df.columns})


def sentiment_summary(entities: DataFrame) -> DataFrame:
    """One row: entity and review totals, entities per class, mean score."""
    per_class = entities.groupBy("dominant_sentiment").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("total_reviews") > 0).alias("with_reviews"),
        F.sum("total_reviews").alias("reviews"),
        F.sum("avg_signed_score").alias("score"),
        F.count("avg_signed_score").alias("scored"),
    )
    # three rows at most
    return per_class.agg(
        F.sum("n").alias("total_entities"),
        F.sum("with_reviews").alias("entities_with_reviews"),
        F.sum("reviews").alias("total_reviews_analysed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dominant_sentiment", "n")))).alias(
            "dominant_sentiment_counts"
        ),
        round_half_even(F.sum("score") / F.sum("scored"), 4).alias("avg_signed_score_overall"),
    )


def score_totals(entities: DataFrame) -> DataFrame:
    return entities.agg(
        F.sum("total_reviews").alias("total_reviews"), F.avg("avg_signed_score").alias("avg_signed_score")
    )
