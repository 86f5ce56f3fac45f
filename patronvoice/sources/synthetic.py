"""Generated listings and reviews.

Every value is a function of the row id and the seed, so the same rows come out
however the range is partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.functions import bin_rating_tier, complement_pct, round_half_even
from patronvoice.sources import fixed


def _uniform(name: str, seed: int, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Uniform in [lo, hi); ``name`` keeps the columns independent."""
    unit = F.pmod(F.xxhash64(F.col("id"), F.lit(name), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.lit(float(lo)) + unit * F.lit(float(hi) - float(lo))


def _normal(name: str, seed: int, mean: float, deviation: float) -> Column:
    radius = F.sqrt(-2.0 * F.log(1.0 - _uniform(name + "-radius", seed)))
    return F.lit(mean) + deviation * radius * F.cos(_uniform(name + "-angle", seed, 0.0, 2 * math.pi))


def _pick(name: str, seed: int, values: Sequence) -> Column:
    at = F.floor(_uniform(name, seed, 0, len(values))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _weighted(name: str, seed: int, weights: Sequence[tuple[str, float]]) -> Column:
    u, upto = _uniform(name, seed), 0.0
    chain = F.when(u < 0, F.lit(None).cast("string"))
    for value, weight in weights[:-1]:
        upto += weight
        chain = chain.when(u < upto, value)
    return chain.otherwise(weights[-1][0])


def _integer(name: str, seed: int, lo: int, hi: int) -> Column:
    return F.floor(_uniform(name, seed, lo, hi)).cast("bigint")


def synthesize_listings(
    spark: SparkSession,
    n: int = 5000,
    seed: int = 42,
    sentiment_weights: Sequence[tuple[str, float]] = fixed.SENTIMENT_WEIGHTS,
    types: Sequence[str] = fixed.SYNTH_TYPES,
    cities: Sequence[str] = fixed.SYNTH_CITIES,
    cuisines: Sequence[str] = fixed.SYNTH_CUISINES,
    costs: Sequence[int] = fixed.SYNTH_COSTS,
) -> DataFrame:
    """Entities with sentiment percentages that fit their dominant class."""
    dominant = F.col("dominant_sentiment")
    positive = F.when(dominant == "positive", _uniform("p1", seed, 55, 90)).otherwise(_uniform("p0", seed, 10, 35))
    negative = F.when(dominant == "negative", _uniform("n1", seed, 50, 85)).otherwise(_uniform("n0", seed, 5, 25))
    rate = F.least(F.greatest(_normal("rate", seed, 3.7, 0.6), F.lit(1.0)), F.lit(5.0))
    return (
        spark.range(n)
        .withColumns(
            {
                "url": F.format_string("listing/%d", "id"),
                "name": F.format_string("Restaurant %d", "id"),
                "rest_type": _pick("type", seed, types),
                "listed_city": _pick("city", seed, cities),
                "primary_cuisine": _pick("cuisine", seed, cuisines),
                "rate": round_half_even(rate, 1),
                "votes": _integer("votes", seed, 10, 50_000),
                "approx_cost": _pick("cost", seed, costs).cast("bigint"),
                "online_order": _weighted("online", seed, fixed.ONLINE_WEIGHTS),
                "book_table": _weighted("table", seed, fixed.TABLE_WEIGHTS),
                "dominant_sentiment": _weighted("sentiment", seed, sentiment_weights),
            }
        )
        .withColumns(
            {
                "sentiment_positive_pct": round_half_even(positive, 1),
                "sentiment_negative_pct": round_half_even(negative, 1),
                "rating_tier": bin_rating_tier(F.col("rate")),
            }
        )
        .withColumns(
            {
                "sentiment_neutral_pct": complement_pct(
                    F.col("sentiment_positive_pct"), F.col("sentiment_negative_pct")
                ),
                "avg_signed_score": round_half_even(_uniform("score", seed, -0.8, 0.9), 3),
                "review_count": _integer("reviews", seed, 0, 300),
                "dominant_complaint": _pick("complaint", seed, [t[0] for t in fixed.DEMO_TOPICS]),
                "cost_tier": _weighted("tier", seed, fixed.COST_TIER_WEIGHTS),
            }
        )
        .withColumn("total_reviews", F.col("review_count"))
        .drop("id")
    )


def synthesize_reviews(
    spark: SparkSession,
    n: int = 3000,
    samples: Sequence[tuple[str, str]] = fixed.SAMPLE_REVIEWS,
    seed: int = 42,
    sentiment_weights: Sequence[tuple[str, float]] = fixed.SENTIMENT_WEIGHTS,
) -> DataFrame:
    """Reviews drawn from (text, topic) samples with an independent class."""
    pairs = F.array(*[F.struct(F.lit(t).alias("review_text"), F.lit(l).alias("topic_label")) for t, l in samples])
    at = F.floor(_uniform("sample", seed, 0, len(samples))).cast("int")
    return (
        spark.range(n)
        .select(
            F.col("id").alias("review_id"),
            F.element_at(pairs, at + 1).alias("sample"),
            _weighted("review-sentiment", seed, sentiment_weights).alias("sentiment"),
        )
        .select("review_id", "sample.*", "sentiment")
    )


def demo_topics(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(fixed.DEMO_TOPICS)]
    return spark.createDataFrame(
        rows, "topic_id int, topic_label string, keywords string, frequency bigint, pct double"
    )
