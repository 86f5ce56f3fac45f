"""Counts, shares, top-k tables and histograms over entities and topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronvoice.functions import (
    RATING_STARS,
    bin_rating_star,
    equal_width_bin,
    map_items_top,
    round_half_even,
    split_keywords,
)
from patronvoice.operators.topics import not_noise

SHOWN_ORDER = ("positive", "neutral", "negative")


# -- building blocks ---------------------------------------------------------


def value_counts(df: DataFrame, col: str, ordered: bool = True) -> DataFrame:
    """(value, count) without null values, most frequent first, then by value."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), col) if ordered else counts


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def top_categories(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).limit(k)


def semi_join_top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows of the k most frequent categories; the other side has k rows."""
    return df.join(F.broadcast(top_categories(df, col, k).select(col)), col, "left_semi")


def facet_filter(
    df: DataFrame,
    cities: Sequence[str] = (),
    types: Sequence[str] = (),
    online: str | None = None,
    city_col: str = "listed_city",
    type_col: str = "rest_type",
    online_col: str = "online_order",
) -> DataFrame:
    """Plain column predicates, which reach the file scan; an empty choice keeps all."""
    if cities:
        df = df.where(F.col(city_col).isin(list(cities)))
    if types:
        df = df.where(F.col(type_col).isin(list(types)))
    if online and online_col in df.columns:
        df = df.where(F.col(online_col) == online)
    return df


def min_reviews_filter(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    return df.where(F.col(col) >= n)


def drop_null_subset(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def crosstab_counts(df: DataFrame, row: str, col: str) -> DataFrame:
    """Long form: (row, col, count) of the pairs that occur."""
    return df.groupBy(row, col).agg(F.count(F.lit(1)).alias("count"))


def group_share(df: DataFrame, value: str, group: str, out_col: str = "pct") -> DataFrame:
    """value / group total x 100. Called on counts: one row per category of a group."""
    total = F.sum(value).over(Window.partitionBy(group))
    return df.withColumn(out_col, F.try_divide(F.col(value), total) * 100)


def crosstab_pct_by_column(df: DataFrame, row: str, col: str) -> DataFrame:
    return group_share(crosstab_counts(df, row, col), "count", col)


def crosstab_pct_by_row(df: DataFrame, row: str, col: str, row_order: Sequence[str], cols: DataFrame) -> DataFrame:
    """Every (row, col) combination in the given row order, absent ones 0; pct null for an empty row.

    ``cols`` is a one-column DataFrame, already limited to a few categories.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("row_order"), F.lit(r).alias(row)) for i, r in enumerate(row_order)]))
    frame = cols.select(col, rows.alias("r")).select(col, "r.*")
    counts = crosstab_counts(df.where(F.col(row).isNotNull()), row, col)
    full = frame.join(counts, [row, col], "left").fillna({"count": 0})
    return group_share(full, "count", row).select("row_order", row, col, "count", "pct")


def share_within_group(df: DataFrame, outer: str, inner: str, digits: int | None = 1) -> DataFrame:
    """(outer, inner, count, pct of the outer group), null keys left out."""
    counted = crosstab_counts(df.dropna(subset=[outer, inner]), outer, inner)
    shared = group_share(counted, "count", outer)
    return shared if digits is None else shared.withColumn("pct", round_half_even(F.col("pct"), digits))


def histogram(df: DataFrame, value: str, by: Sequence[str], lo: float | None, hi: float | None, bins: int) -> DataFrame:
    """(by, bin, bin_start, count) over equal bins.

    A bound that is None is the data's own smallest or largest finite value, so
    that no value is left out; a single value gets half a unit on either side.
    Values outside given bounds are left out.
    """
    if lo is None or hi is None:
        finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
        ends = df.agg(F.min(finite).cast("double"), F.max(finite).cast("double")).first()
        lo, hi = (ends[0] or 0.0) if lo is None else lo, (ends[1] or 0.0) if hi is None else hi
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
    binned = df.withColumn("bin", equal_width_bin(F.col(value), lo, hi, bins)).where(F.col("bin").isNotNull())
    counts = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("bin_start", F.lit(float(lo)) + F.col("bin") * F.lit((hi - lo) / bins))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: least-squares slope and intercept of y on x, smallest and largest x."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("x_min"),
        F.max(x).alias("x_max"),
        F.count(F.lit(1)).alias("points"),
    )


def display_row_number(df: DataFrame, order: Sequence, name: str = "row") -> DataFrame:
    """1-based ordinal of an already short table."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a digest of seed and key: the same rows however the table is split."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}#"), F.col(key).cast("string")).cast("binary")), key).limit(n)


# -- overview ----------------------------------------------------------------


def kpi_overview(
    entities: DataFrame, sentiment: str = "dominant_sentiment", rate: str = "rate", reviews: str = "review_count"
) -> DataFrame:
    share = lambda c: F.avg(F.coalesce(F.col(sentiment) == c, F.lit(False)).cast("int")) * 100
    return entities.agg(
        F.count(F.lit(1)).alias("entities"),
        share("positive").alias("positive_pct"),
        share("negative").alias("negative_pct"),
        F.avg(rate).alias("avg_rate"),
        F.coalesce(F.sum(reviews), F.lit(0)).alias("total_reviews"),
    )


def class_share(entities: DataFrame, classes: Sequence[str] = SHOWN_ORDER, col: str = "dominant_sentiment") -> DataFrame:
    return entities.agg(
        *[(F.avg(F.coalesce(F.col(col) == c, F.lit(False)).cast("int")) * 100).alias(f"{c}_pct") for c in classes]
    )


class_share_cards = class_share


def sentiment_split(entities: DataFrame) -> DataFrame:
    return value_counts(entities, "dominant_sentiment")


def sentiment_distribution(entities: DataFrame, col: str = "dominant_sentiment") -> DataFrame:
    """One row per class in fixed order, also for absent classes: count, percent, total."""
    one = entities.agg(*[F.count_if(F.col(col) == c).alias(c) for c in SHOWN_ORDER])
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("sentiment"), F.col(c).alias("count")) for i, c in enumerate(SHOWN_ORDER)]
    total = sum((F.col(c) for c in SHOWN_ORDER), F.lit(0))
    return (
        one.select(total.alias("total"), F.inline(F.array(*rows)))
        .withColumn("pct", round_half_even(F.try_divide(F.col("count"), F.col("total")) * 100, 1))
    )


def type_breakdown(entities: DataFrame, k: int = 7, col: str = "rest_type") -> DataFrame:
    return top_categories(entities, col, k)


def rating_histogram(entities: DataFrame, bins: int = 30, col: str = "rate", lo: float = 1.0, hi: float = 5.0) -> DataFrame:
    return histogram(entities, col, [], lo, hi, bins)


# -- sentiment ---------------------------------------------------------------


def mean_by_group(df: DataFrame, group: str, values: Sequence[str], digits: int = 1) -> DataFrame:
    """Rounded group means, groups ordered by their sum."""
    means = df.groupBy(group).agg(*[round_half_even(F.avg(v), digits).alias(v) for v in values])
    return means.orderBy(sum((F.col(v) for v in values), F.lit(0.0)), group)


def sentiment_by_type(entities: DataFrame, k: int = 8, col: str = "rest_type") -> DataFrame:
    return mean_by_group(semi_join_top_k(entities, col, k), col, [f"sentiment_{c}_pct" for c in SHOWN_ORDER])


def _rated(entities: DataFrame) -> DataFrame:
    return entities.where(
        F.col("rate").isNotNull() & F.col("avg_signed_score").isNotNull() & (F.col("total_reviews") > 0)
    )


def sentiment_vs_rating(entities: DataFrame) -> DataFrame:
    """Points of the scatter, with the fitted value of the trend line."""
    points = _rated(entities)
    trend = linear_trend(points, "rate", "avg_signed_score")
    line = trend.select(F.struct("slope", "intercept")).scalar()
    return points.select(
        "name",
        "rate",
        "avg_signed_score",
        "dominant_sentiment",
        (line["slope"] * F.col("rate") + line["intercept"]).alias("fitted"),
    )


def sentiment_rating_trend(entities: DataFrame) -> DataFrame:
    return linear_trend(_rated(entities), "rate", "avg_signed_score")


def top_negative_entities(
    entities: DataFrame, k: int = 15, min_reviews: int = 5, key: str = "url", count_col: str = "total_reviews"
) -> DataFrame:
    return (
        min_reviews_filter(entities, count_col, min_reviews)
        .orderBy(F.desc_nulls_last("sentiment_negative_pct"), key)
        .limit(k)
        .select(key, "name", "sentiment_negative_pct", "sentiment_positive_pct", count_col)
    )


def top_negative_table(
    entities: DataFrame, k: int = 12, min_reviews: int = 5, key: str = "url", count_col: str = "review_count"
) -> DataFrame:
    """The k worst as a numbered display table."""
    order = [F.desc_nulls_last("sentiment_negative_pct"), F.col(key)]
    top = min_reviews_filter(entities, count_col, min_reviews).orderBy(*order).limit(k)
    return display_row_number(top, order).select(
        "row",
        F.col("name").alias("entity"),
        F.col("sentiment_negative_pct").alias("negative_pct"),
        F.col("sentiment_positive_pct").alias("positive_pct"),
        F.col("rest_type").alias("type"),
        F.col("rate").alias("rating"),
    )


def score_histogram(reviews: DataFrame, bins: int = 39) -> DataFrame:
    """Signed scores of reviews in [-1, 1] per class, with the class total."""
    counts = histogram(reviews, "signed_score", ["sentiment"], -1.0, 1.0, bins)
    # at most ``bins`` rows per class
    return counts.withColumn("class_total", F.sum("count").over(Window.partitionBy("sentiment")))


def score_histogram_by_class(entities: DataFrame, bins: int = 50) -> DataFrame:
    rows = drop_null_subset(entities, ["avg_signed_score", "dominant_sentiment"])
    return histogram(rows, "avg_signed_score", ["dominant_sentiment"], -1.0, 1.0, bins)


def score_rating_sample(entities: DataFrame, n: int = 2000, seed: int = 42, key: str = "url") -> DataFrame:
    rows = drop_null_subset(entities, ["rate", "avg_signed_score", "dominant_sentiment"])
    return random_sample(rows.select(key, "rate", "avg_signed_score", "dominant_sentiment"), key, n, seed)


def sentiment_share_by_type(entities: DataFrame, k: int = 7, col: str = "rest_type") -> DataFrame:
    return share_within_group(semi_join_top_k(entities, col, k), col, "dominant_sentiment", None)


# -- complaints --------------------------------------------------------------


def top_topics(topics: DataFrame, k: int) -> DataFrame:
    return not_noise(topics).orderBy(F.desc("frequency"), "topic_id").limit(k)


def topic_frequency(topics: DataFrame, k: int = 10) -> DataFrame:
    return top_topics(topics, k).select("topic_id", "topic_label", "frequency", "pct")


def top_complaint_topics(topics: DataFrame, k: int = 8) -> DataFrame:
    return topic_frequency(topics, k)


def topic_frequency_full(topics: DataFrame) -> DataFrame:
    return topics.select("topic_id", "topic_label", "frequency", "pct").orderBy(F.desc("frequency"), "topic_id")


def topic_keyword_weights(topics: DataFrame, k: int = 8, words: int = 8) -> DataFrame:
    """(topic, position, word, weight) of the first words of the k most frequent topics."""
    top = top_topics(topics, k).where(F.size("kw_weights") > 0)
    items = top.select("topic_id", "topic_label", F.posexplode(map_items_top(F.col("kw_weights"), words)).alias("position", "item"))
    return items.select("topic_id", "topic_label", "position", F.col("item.key").alias("word"), F.col("item.value").alias("weight"))


def topic_by_type_heatmap(
    entities: DataFrame, topics: DataFrame, k_topics: int = 8, k_types: int = 7, col: str = "rest_type"
) -> DataFrame:
    """(topic, type, count, % of the type's complaints) with the type's rank."""
    labels = top_topics(topics, k_topics).select(F.col("topic_label").alias("dominant_complaint")).distinct()
    types = display_row_number(top_categories(entities, col, k_types), [F.desc("count"), col], "type_rank")
    # both sides have k rows
    kept = entities.join(F.broadcast(labels), "dominant_complaint", "left_semi").join(
        F.broadcast(types.select(col, "type_rank")), col
    )
    counts = kept.groupBy("dominant_complaint", col, "type_rank").agg(F.count(F.lit(1)).alias("count"))
    return group_share(counts, "count", col)


def topics_over_rating(entities: DataFrame, topics: DataFrame, k: int = 5) -> DataFrame:
    """% of each star bin's complaints per top topic, all bins in order."""
    labels = top_topics(topics, k).select(F.col("topic_label").alias("dominant_complaint")).distinct()
    rows = drop_null_subset(entities, ["rate", "dominant_complaint"]).join(
        F.broadcast(labels), "dominant_complaint", "left_semi"
    )
    binned = rows.withColumn("rating_bin", bin_rating_star(F.col("rate")))
    return crosstab_pct_by_row(binned, "rating_bin", "dominant_complaint", RATING_STARS[1], labels)


def complaints_by_city(entities: DataFrame, k: int = 6, col: str = "listed_city") -> DataFrame:
    return share_within_group(semi_join_top_k(entities, col, k), col, "dominant_complaint")


def complaints_by_rating_tier(entities: DataFrame, col: str = "rating_tier") -> DataFrame:
    return share_within_group(entities, col, "dominant_complaint")


def topic_deep_dive(topics: DataFrame, k: int = 8, keyword_text: bool = False) -> DataFrame:
    """Label, frequency, percent and the first k keywords (array, or comma text)."""
    words = split_keywords(F.col("keywords"), k) if keyword_text else F.slice("keywords", 1, k)
    return topics.select("topic_label", "frequency", "pct", words.alias("keywords"))


def topic_listing(topics: DataFrame, k: int = 5) -> DataFrame:
    return not_noise(topics).select(
        "topic_id", "topic_label", F.array_join(F.slice("keywords", 1, k), ", ").alias("keywords"), "frequency", "pct"
    )
