"""Planning queries: every part is a planned feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronvoice.functions import round_half_even
from patronvoice.operators import planning as ops
from patronvoice.sources.fixed import RECOMMENDATIONS, recommendations
from registry.base import CTES, register, rnd

FEATURES = {
    "feature": "concat(p_name, ' ', CAST(p_partkey AS STRING))",
    "topic": "p_type",
    "reach": "CAST(p_partkey % 100 AS INT)",
    "impact": "CASE p_partkey % 5 WHEN 0 THEN 0.25e0 WHEN 1 THEN 0.5e0 WHEN 2 THEN 1e0 WHEN 3 THEN 2e0 ELSE 3e0 END",
    "conf": "CAST(50 + p_size AS INT)",
    "effort": "CAST(p_partkey % 13 AS DOUBLE) / 2e0",
    "sprint": "CAST(1 + p_partkey % 3 AS INT)",
}
CTES["features"] = ((), "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FEATURES.items()) + " FROM part")
CTES["rice"] = (
    ("features",),
    "SELECT *, CASE WHEN effort > 0 THEN CAST(round_even(reach * impact * conf / 100e0 / effort, 0) AS BIGINT) END AS rice FROM features",
)


def _features(t):
    return t.part.selectExpr(*[f"{e} AS {n}" for n, e in FEATURES.items()])


@register("rice_score", "SELECT feature, rice FROM rice", "rice")
def _(t):
    return ops.add_rice(_features(t)).select("feature", "rice")


@register("rice_table", "SELECT feature, topic, reach, impact, conf, effort, rice, sprint FROM rice WHERE sprint = 1 AND topic = 'PROMO'", "rice")
def _(t):
    return ops.rice_table(_features(t), sprint=1, topic="PROMO")


@register(
    "rice_rank",
    "SELECT feature, topic, reach, impact, conf, effort, rice, sprint, CAST(row_number() OVER (ORDER BY effort, feature) AS INT) AS rank FROM rice ORDER BY effort, feature LIMIT 20",
    "rice",
)
def _(t):
    return ops.rice_table(_features(t), by="effort", k=20)


@register("rice_summary", "SELECT count(*) AS features, count(*) FILTER (sprint = 1) AS sprint_1, max(rice) AS max_rice, median(rice) AS median_rice FROM rice", "rice")
def _(t):
    return ops.rice_summary(ops.add_rice(_features(t)))


@register(
    "rice_what_if",
    "SELECT CAST(round_even(50e0 * 2 * 75 / 100 / 2.0e0, 0) AS BIGINT) AS rice, median(rice) AS median_rice, CASE WHEN round_even(37.5e0, 0) > median(rice) THEN 'Above' ELSE 'Below' END AS versus_median FROM rice",
    "rice",
)
def _(t):
    return ops.rice_what_if(ops.add_rice(_features(t)), 50, 2, 75, 2.0)


@register("rice_effort_tradeoff", "SELECT feature, effort, rice, reach, sprint FROM rice", "rice")
def _(t):
    return ops.rice_effort_tradeoff(ops.add_rice(_features(t)))


def _quoted(*texts: str) -> str:
    return ", ".join("'" + t.format(platform="the platform").replace("'", "''") + "'" for t in texts)


def advice_sql(*topics: str) -> str:
    """The advice on the topics, one row per solution and impact, with the measured frequency of each topic."""
    rows = [
        f"({_quoted(topic, ' | '.join(pain), ' | '.join(root), s[0], s[1], s[2], metric, expected)})"
        for topic, _, _, pain, root, solutions, impact in RECOMMENDATIONS
        if topic in topics
        for s in solutions
        for metric, expected in impact.items()
    ]
    return (
        f"SELECT r.*, m.frequency, {rnd('m.pct', 2)} AS pct FROM (VALUES {', '.join(rows)}) r(topic, pain, root, title, \"desc\", tag, metric, expected) "
        "JOIN topic_table m ON m.topic_label = r.topic"
    )


def whole_advice(advice):
    texts = [F.array_join(c, " | ").alias(c) for c in ("pain", "root")]
    return advice.select("topic", *texts, "title", "desc", "tag", "metric", "expected", "frequency", round_half_even(F.col("pct"), 2).alias("pct"))


@register("recommendations_by_topic", advice_sql(*[r[0] for r in RECOMMENDATIONS]), "topic_table")
def _(t):
    return whole_advice(ops.recommendations_by_topic(t.topic_table, recommendations(t.spark)))
