"""Feature planning: RICE scores and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.functions import rice_score
from patronvoice.operators.breakdowns import display_row_number
from patronvoice.operators.joins import lookup_join
from patronvoice.operators.quantiles import global_median

RICE_ORDERS = {"rice": F.desc, "reach": F.desc, "impact": F.desc, "effort": F.asc}


def add_rice(features: DataFrame) -> DataFrame:
    score = rice_score(F.col("reach"), F.col("impact"), F.col("conf"), F.col("effort"))
    return features.withColumn("rice", score)


def rice_filter(rice: DataFrame, sprint: int | None = None, topic: str | None = None) -> DataFrame:
    if sprint is not None:
        rice = rice.where(F.col("sprint") == sprint)
    if topic is not None:
        rice = rice.where(F.col("topic") == topic)
    return rice


def rice_rank(rice: DataFrame, by: str = "rice") -> DataFrame:
    """Highest first; effort lowest first; ties by feature."""
    return rice.orderBy(RICE_ORDERS[by](by), "feature")


def rice_table(
    features: DataFrame,
    sprint: int | None = None,
    topic: str | None = None,
    by: str = "rice",
    k: int | None = None,
) -> DataFrame:
    """Filtered, scored and ranked; the top ``k`` are also numbered."""
    scored = rice_filter(add_rice(features), sprint, topic)
    ranked = rice_rank(scored, by).select("feature", "topic", "reach", "impact", "conf", "effort", "rice", "sprint")
    if k is None:
        return ranked
    return display_row_number(ranked.limit(k), [RICE_ORDERS[by](by), "feature"], "rank")


def rice_summary(rice: DataFrame) -> DataFrame:
    """One row: features, features of sprint 1, highest and median score."""
    return rice.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("sprint") == 1).alias("sprint_1"),
        F.max("rice").alias("max_rice"),
    ).withColumn("median_rice", global_median(rice, "rice").scalar())


def rice_what_if(rice: DataFrame, reach: float, impact: float, conf: float, effort: float) -> DataFrame:
    """One row: score of an imagined feature, the median, and whether it lies above."""
    score = rice_score(F.lit(float(reach)), F.lit(float(impact)), F.lit(float(conf)), F.lit(float(effort)))
    side = F.when(F.col("rice") > F.col("median_rice"), "Above").otherwise("Below")
    return global_median(rice, "rice").select(score.alias("rice"), F.col("median").alias("median_rice")).withColumn(
        "versus_median", side
    )


def rice_effort_tradeoff(rice: DataFrame) -> DataFrame:
    return rice.select("feature", "effort", "rice", "reach", "sprint")


def recommendation_filter(recs: DataFrame, topic: str = "All") -> DataFrame:
    return recs if topic == "All" else recs.where(F.col("topic") == topic)


def recommendations_by_topic(topics: DataFrame, recs: DataFrame, topic: str = "All") -> DataFrame:
    """Advice with the measured frequency of its topic, one row per solution and impact.

    A topic without a match in ``topics`` keeps the advice's own numbers.
    """
    measured = topics.groupBy(F.col("topic_label").alias("topic")).agg(
        F.sum("frequency").alias("frequency"), F.sum("pct").alias("measured_pct")
    )
    joined = lookup_join(recommendation_filter(recs, topic), measured, ["topic"]).select(
        "topic",
        F.coalesce("frequency", "freq").alias("frequency"),
        F.coalesce("measured_pct", "pct").alias("pct"),
        "pain",
        "root",
        F.explode("solutions").alias("solution"),
        "impact",
    )
    return joined.select(
        "topic",
        "frequency",
        "pct",
        "pain",
        "root",
        "solution.*",
        F.explode("impact").alias("metric", "expected"),
    )
