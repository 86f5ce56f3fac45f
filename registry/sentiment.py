"""Sentiment queries: one review per line item, one entity per part."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronvoice import functions as fn
from patronvoice.operators import breakdowns as b
from patronvoice.operators import sentiment as ops
from patronvoice.operators.scorers import LabelScorer, score_sentiment
from patronvoice.plans.sentiment import review_sentiment
from registry.base import CTES, LINE_LABEL, LINE_SCORE, _aggregate, _scored, r6, register, rnd


def _pick(*cols: str) -> str:
    return "SELECT " + ", ".join(cols)


_AGG_COLS = (
    "url",
    "total_reviews",
    "positive_count",
    "negative_count",
    "neutral_count",
    "sentiment_positive_pct",
    "sentiment_negative_pct",
    "sentiment_neutral_pct",
    "avg_signed_score",
    "dominant_sentiment",
)
_VOLATILITY = rnd("sentiment_volatility", 6) + " AS sentiment_volatility"


_FLAT = "trim(replace(text, chr(10), ' '), concat(' ', chr(9), chr(13)))"


@register("truncate_for_model", f"SELECT doc_id, {_FLAT} AS whole_text, substring({_FLAT}, 1, 512) AS model_text FROM documents")
def _(t):
    text = F.col("text")
    return t.documents.select("doc_id", fn.truncate_for_model(text, None).alias("whole_text"), fn.truncate_for_model(text, 512).alias("model_text"))


@register("neutral_threshold", "SELECT review_id, raw_label, score, sentiment FROM docs_scored", "docs_scored")
def _(t):
    c = fn.neutral_threshold(F.col("raw_label"), F.col("score"))
    return t.docs.select("review_id", "raw_label", "score", c.alias("sentiment"))


@register("signed_score", "SELECT sentiment, count(*) AS n, " + rnd("sum(signed_score)", 4) + " AS total FROM lines_scored GROUP BY 1", "lines_scored")
def _(t):
    got = t.lines_scored.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"), F.sum("signed_score").alias("total"))
    return got.withColumn("total", fn.round_half_even(F.col("total"), 4))


@register("sentiment_by_entity", _pick("url", "total_reviews", "positive_count", "negative_count", "neutral_count", "avg_signed_score", _VOLATILITY) + " FROM agg", "agg")
def _(t):
    got = ops.sentiment_by_entity(t.lines_scored)
    return got.withColumns({"avg_signed_score": fn.round_half_even(F.col("avg_signed_score"), 4), "sentiment_volatility": r6("sentiment_volatility")})


@register("class_percentages", _pick("url", "sentiment_positive_pct", "sentiment_negative_pct", "sentiment_neutral_pct") + " FROM docs_agg", "docs_agg")
def _(t):
    got = ops.class_percentages(ops.sentiment_by_entity(t.docs_scored))
    return got.select("url", *[f"sentiment_{c}_pct" for c in ops.CLASSES])


@register("dominant_sentiment", _pick("url", "dominant_sentiment") + " FROM docs_agg", "docs_agg")
def _(t):
    return ops.dominant_sentiment(ops.sentiment_by_entity(t.docs_scored)).select("url", "dominant_sentiment")


@register(
    "attach_sentiment",
    "SELECT e.url, e.name, a.total_reviews, a.dominant_sentiment FROM ent e LEFT JOIN agg a ON e.url = a.url",
    "ent",
    "agg",
)
def _(t):
    got = ops.attach_sentiment(t.ent, ops.entity_sentiment(t.lines_scored))
    return got.select("url", "name", "total_reviews", "dominant_sentiment")


@register("fill_defaults_after_join", _pick(*_AGG_COLS, _VOLATILITY) + " FROM ent_s", "ent_s")
def _(t):
    filled = ops.fill_defaults_after_join(ops.attach_sentiment(t.ent, ops.entity_sentiment(t.lines_scored)))
    return filled.select(*_AGG_COLS, r6("sentiment_volatility").alias("sentiment_volatility"))


CTES["line_labels"] = (("doc_lines",), f"SELECT *, {LINE_LABEL} AS raw_label, {LINE_SCORE} AS score FROM doc_lines")
CTES["line_labels_scored"] = (("line_labels",), _scored("line_labels"))
CTES["line_agg"] = (("line_labels_scored",), _aggregate("line_labels_scored"))


@register("review_sentiment", _pick("d.doc_id AS url", "coalesce(total_reviews, 0) AS total_reviews", "coalesce(dominant_sentiment, 'neutral') AS dominant_sentiment", "coalesce(avg_signed_score, 0e0) AS avg_signed_score") + " FROM documents d LEFT JOIN line_agg a ON d.doc_id = a.url", "line_agg")
def _(t):
    """Nested reviews all the way: explode, score, aggregate, attach, fill."""

    def scorer(df, text_col):
        return df.withColumns({"raw_label": F.expr(LINE_LABEL), "score": F.expr(LINE_SCORE)})

    got, _ = review_sentiment(t.nested, scorer)
    return got.select("url", "total_reviews", "dominant_sentiment", "avg_signed_score")


@register("score_labelled_reviews", "SELECT review_id, raw_label, " + rnd("score", 4) + " AS confidence, sentiment, " + rnd("signed_score", 4) + " AS signed_score FROM docs_scored", "docs_scored")
def _(t):
    got = score_sentiment(t.docs, "review_text", LabelScorer())
    return got.select("review_id", "raw_label", "confidence", "sentiment", fn.round_half_even(F.col("signed_score"), 4).alias("signed_score"))


@register(
    "sentiment_summary",
    "SELECT count(*) AS total_entities, count(*) FILTER (total_reviews > 0) AS entities_with_reviews, sum(total_reviews)::BIGINT AS total_reviews_analysed, "
    "count(*) FILTER (dominant_sentiment = 'positive') AS positive, count(*) FILTER (dominant_sentiment = 'negative') AS negative, "
    + rnd("avg(avg_signed_score)", 4)
    + " AS avg_signed_score_overall FROM ent_s",
    "ent_s",
)
def _(t):
    counts = F.col("dominant_sentiment_counts")
    return ops.sentiment_summary(t.ent_s).select(
        "total_entities",
        "entities_with_reviews",
        "total_reviews_analysed",
        counts["positive"].alias("positive"),
        counts["negative"].alias("negative"),
        "avg_signed_score_overall",
    )


@register("score_totals", "SELECT sum(total_reviews)::BIGINT AS total_reviews, " + rnd("avg(avg_signed_score)", 6) + " AS avg_signed_score FROM ent_s", "ent_s")
def _(t):
    got = ops.score_totals(t.ent_s)
    return got.withColumn("avg_signed_score", r6("avg_signed_score"))


@register(
    "sentiment_distribution",
    "WITH c AS (SELECT * FROM (VALUES (0, 'positive'), (1, 'neutral'), (2, 'negative')) v(position, sentiment)), "
    "n AS (SELECT dominant_sentiment, count(*) AS count FROM ent_s GROUP BY 1) "
    "SELECT c.position, c.sentiment, coalesce(n.count, 0) AS count, sum(coalesce(n.count, 0)) OVER ()::BIGINT AS total, "
    + rnd("CAST(coalesce(n.count, 0) AS DOUBLE) / sum(n.count) OVER () * 100", 1)
    + " AS pct FROM c LEFT JOIN n ON c.sentiment = n.dominant_sentiment",
    "ent_s",
)
def _(t):
    return b.sentiment_distribution(t.ent_s)


_TOP = "(SELECT {0} FROM ent_s WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT {1})"


@register(
    "sentiment_by_type",
    "SELECT rest_type, "
    + ", ".join(f"{rnd(f'avg(sentiment_{c}_pct)', 1)} AS sentiment_{c}_pct" for c in ("positive", "neutral", "negative"))
    + f" FROM ent_s WHERE rest_type IN {_TOP.format('rest_type', 4)} GROUP BY 1",
    "ent_s",
)
def _(t):
    return b.sentiment_by_type(t.ent_s, k=4)


CTES["rated"] = (("ent_s",), "SELECT * FROM ent_s WHERE rate IS NOT NULL AND avg_signed_score IS NOT NULL AND total_reviews > 0")
_TREND = "SELECT regr_slope(avg_signed_score, rate) AS slope, regr_intercept(avg_signed_score, rate) AS intercept, min(rate) AS x_min, max(rate) AS x_max, count(*) AS points FROM rated"


@register("linear_trend", f"SELECT {rnd('slope', 6)} AS slope, {rnd('intercept', 6)} AS intercept, x_min, x_max, points FROM ({_TREND})", "rated")
def _(t):
    return b.sentiment_rating_trend(t.ent_s).withColumns({"slope": r6("slope"), "intercept": r6("intercept")})


@register(
    "sentiment_vs_rating",
    f"SELECT name, rate, avg_signed_score, dominant_sentiment, {rnd('slope * rate + intercept', 6)} AS fitted FROM rated, ({_TREND})",
    "rated",
)
def _(t):
    return b.sentiment_vs_rating(t.ent_s).withColumn("fitted", r6("fitted"))


CTES["docs_entities"] = ((), "SELECT DISTINCT concat(lang, '/', source) AS url, source AS name FROM documents")
CTES["docs_named"] = (("docs_entities", "docs_agg"), "SELECT e.name, a.* FROM docs_entities e LEFT JOIN docs_agg a ON e.url = a.url")


@register(
    "top_negative_entities",
    "SELECT url, name, sentiment_negative_pct, sentiment_positive_pct, total_reviews FROM docs_named WHERE total_reviews >= 5 "
    "ORDER BY sentiment_negative_pct DESC, url LIMIT 15",
    "docs_named",
)
def _(t):
    entities = t.docs.select("url", "name").distinct()
    return b.top_negative_entities(
        ops.fill_defaults_after_join(ops.attach_sentiment(entities, ops.entity_sentiment(t.docs_scored)))
    )


@register(
    "top_negative_table",
    "SELECT CAST(row_number() OVER (ORDER BY sentiment_negative_pct DESC, url) AS INT) AS row, name AS entity, sentiment_negative_pct AS negative_pct, "
    "sentiment_positive_pct AS positive_pct, rest_type AS type, rate AS rating FROM ent_s WHERE review_count >= 5 ORDER BY sentiment_negative_pct DESC, url LIMIT 12",
    "ent_s",
)
def _(t):
    return b.top_negative_table(t.ent_s)


@register("min_reviews_filter", "SELECT url, total_reviews FROM agg WHERE total_reviews >= 5", "agg")
def _(t):
    return b.min_reviews_filter(ops.sentiment_by_entity(t.lines_scored).select("url", "total_reviews"), "total_reviews")


def _bin(value: str, lo: str, hi: str, bins: int, width: float) -> str:
    guess = f"least(CAST(floor(({value} - ({lo})) / {width!r}e0) AS INT), {bins - 1})"
    edge = f"(({lo}) + CAST(g + {{0}} AS DOUBLE) * {width!r}e0)"
    return (
        f"SELECT *, CASE WHEN v < {edge.format(0)} THEN g - 1 WHEN g < {bins - 1} AND v >= {edge.format(1)} THEN g + 1 ELSE g END AS bin FROM "
        f"(SELECT *, {value} AS v, {guess} AS g FROM {{src}} WHERE {value} BETWEEN {lo} AND {hi})"
    )


def _start(lo: str, width: float) -> str:
    return rnd(f"{lo} + bin * {width!r}e0", 6) + " AS bin_start"


_W39, _W50, _W30 = 2 / 39, 2 / 50, 4 / 30


@register(
    "score_histogram",
    f"SELECT sentiment, bin, count(*) AS count, sum(count(*)) OVER (PARTITION BY sentiment)::BIGINT AS class_total, {_start('-1e0', _W39)} FROM ("
    + _bin("signed_score", "-1e0", "1e0", 39, _W39).format(src="lines_scored")
    + ") GROUP BY sentiment, bin",
    "lines_scored",
)
def _(t):
    return b.score_histogram(t.lines_scored).withColumn("bin_start", r6("bin_start"))


@register(
    "score_histogram_by_class",
    f"SELECT dominant_sentiment, bin, count(*) AS count, {_start('-1e0', _W50)} FROM ("
    + _bin("avg_signed_score", "-1e0", "1e0", 50, _W50).format(src="ent_s")
    + ") GROUP BY dominant_sentiment, bin",
    "ent_s",
)
def _(t):
    return b.score_histogram_by_class(t.ent_s).withColumn("bin_start", r6("bin_start"))


@register(
    "rating_histogram",
    f"SELECT bin, count(*) AS count, {_start('1e0', _W30)} FROM (" + _bin("rate", "1e0", "5e0", 30, _W30).format(src="ent") + ") GROUP BY bin",
    "ent",
)
def _(t):
    return b.rating_histogram(t.ent).withColumn("bin_start", r6("bin_start"))


@register(
    "kpi_overview",
    "SELECT count(*) AS entities, "
    + rnd("avg(CASE WHEN dominant_sentiment = 'positive' THEN 1e0 ELSE 0e0 END) * 100", 6)
    + " AS positive_pct, "
    + rnd("avg(CASE WHEN dominant_sentiment = 'negative' THEN 1e0 ELSE 0e0 END) * 100", 6)
    + " AS negative_pct, "
    + rnd("avg(rate)", 6)
    + " AS avg_rate, sum(review_count)::BIGINT AS total_reviews FROM ent_s",
    "ent_s",
)
def _(t):
    return b.kpi_overview(t.ent_s).withColumns({c: r6(c) for c in ("positive_pct", "negative_pct", "avg_rate")})


@register(
    "class_share",
    "SELECT "
    + ", ".join(rnd(f"avg(CASE WHEN dominant_sentiment = '{c}' THEN 1e0 ELSE 0e0 END) * 100", 6) + f" AS {c}_pct" for c in ("positive", "neutral", "negative"))
    + " FROM ent_s",
    "ent_s",
)
def _(t):
    return b.class_share(t.ent_s).select(*[r6(f"{c}_pct").alias(f"{c}_pct") for c in b.SHOWN_ORDER])


@register("sentiment_split", "SELECT dominant_sentiment, count(*) AS count FROM ent_s GROUP BY 1", "ent_s")
def _(t):
    return b.sentiment_split(t.ent_s)


@register("type_breakdown", "SELECT rest_type, count(*) AS count FROM ent GROUP BY 1 ORDER BY count(*) DESC, rest_type LIMIT 4", "ent")
def _(t):
    return b.type_breakdown(t.ent, k=4)


@register("top_categories", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6")
def _(t):
    return b.top_categories(t.part, "p_brand", 6)


@register("semi_join_top_k", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 6)")
def _(t):
    return b.semi_join_top_k(t.part.select("p_partkey", "p_brand"), "p_brand", 6)


@register("distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return b.distinct_values(t.part, "p_brand")


@register(
    "facet_filter",
    "SELECT url, name, rate FROM ent WHERE listed_city IN ('Brand#1', 'Brand#2', 'Brand#3') AND rest_type IN ('ECONOMY', 'SMALL') AND online_order = 'Yes'",
    "ent",
)
def _(t):
    got = b.facet_filter(t.ent, ["Brand#1", "Brand#2", "Brand#3"], ["ECONOMY", "SMALL"], "Yes")
    return got.select("url", "name", "rate")


@register(
    "sentiment_share_by_type",
    "SELECT rest_type, dominant_sentiment, count(*) AS count, "
    + rnd("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY rest_type) * 100", 6)
    + f" AS pct FROM ent_s WHERE rest_type IN {_TOP.format('rest_type', 4)} GROUP BY 1, 2",
    "ent_s",
)
def _(t):
    return b.sentiment_share_by_type(t.ent_s, k=4).withColumn("pct", r6("pct"))


@register(
    "score_rating_sample",
    "SELECT url, rate, " + rnd("avg_signed_score", 4) + " AS avg_signed_score, dominant_sentiment FROM ent_s "
    "WHERE rate IS NOT NULL AND avg_signed_score IS NOT NULL AND dominant_sentiment IS NOT NULL ORDER BY md5(concat('42#', CAST(url AS VARCHAR))), url LIMIT 2000",
    "ent_s",
)
def _(t):
    return b.score_rating_sample(t.ent_s).withColumn("avg_signed_score", fn.round_half_even(F.col("avg_signed_score"), 4))


@register("drop_null_subset", "SELECT url, rate, approx_cost FROM ent WHERE rate IS NOT NULL AND approx_cost IS NOT NULL", "ent")
def _(t):
    return b.drop_null_subset(t.ent.select("url", "rate", "approx_cost"), ["rate", "approx_cost"])


@register("crosstab_counts", "SELECT p_type, p_brand, count(*) AS count FROM part GROUP BY 1, 2")
def _(t):
    return b.crosstab_counts(t.part, "p_type", "p_brand")


@register(
    "crosstab_pct_by_column",
    "SELECT l_returnflag, l_linestatus, count(*) AS count, " + rnd("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY l_linestatus) * 100", 6) + " AS pct FROM lineitem GROUP BY 1, 2",
)
def _(t):
    return b.crosstab_pct_by_column(t.read("lineitem"), "l_returnflag", "l_linestatus").withColumn("pct", r6("pct"))


@register(
    "share_within_group",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS count, " + rnd("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY o_orderpriority) * 100", 1) + " AS pct FROM orders GROUP BY 1, 2",
)
def _(t):
    return b.share_within_group(t.read("orders"), "o_orderpriority", "o_orderstatus")
