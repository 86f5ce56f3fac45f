"""Topic tables: summary, labels, reranked keywords, per-entity complaint features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronvoice.functions import derive_label, join_keywords, round_half_even
from patronvoice.operators.joins import lookup_join
from patronvoice.operators.terms import explode_known_terms, explode_terms
from patronvoice.operators.vectors import cosine, mean_vectors
from patronvoice.session import materialize
from patronvoice.sources.fixed import TAXONOMY

NOISE = -1
NOISE_LABEL = "Uncategorised / noise"
MAX_LITERAL_TERMS = 20_000


def not_noise(df: DataFrame, id_col: str = "topic_id", noise: int = NOISE) -> DataFrame:
    return df.where(F.col(id_col) != noise)


def topic_summary(
    review_topics: DataFrame,
    keywords: DataFrame,
    topic_col: str = "topic_id",
    taxonomy: Sequence[tuple[str, Sequence[str]]] = TAXONOMY,
) -> DataFrame:
    """One row per topic with frequency, percent of all texts, keywords, weights and label."""
    counts = review_topics.groupBy(topic_col).agg(F.count(F.lit(1)).alias("frequency"))
    total = counts.agg(F.sum("frequency")).scalar()
    label = F.when(F.col(topic_col) == NOISE, NOISE_LABEL).otherwise(
        derive_label(F.coalesce("keywords", F.array().cast("array<string>")), taxonomy)
    )
    return lookup_join(counts, keywords, [topic_col]).select(
        topic_col,
        label.alias("topic_label"),
        "keywords",
        "kw_weights",
        "frequency",
        round_half_even(F.col("frequency") / total * 100, 2).alias("pct"),
    )


def sort_topics(topics: DataFrame) -> DataFrame:
    return topics.orderBy(F.desc("frequency"), "topic_id")


def label_topics(reviews: DataFrame, topics: DataFrame, topic_col: str = "topic_id") -> DataFrame:
    """Adds the topic's label, ``unknown`` when there is none; frequent topics are spread."""
    labels = topics.select(topic_col, "topic_label")
    return lookup_join(reviews, labels, [topic_col], salts=16).withColumn(
        "topic_label", F.coalesce("topic_label", F.lit("unknown"))
    )


def rerank_keywords(
    candidates: DataFrame,
    docs: DataFrame,
    text_col: str,
    vec_col: str,
    topic_col: str = "topic_id",
    k: int = 10,
    ngrams: tuple[int, int] = (1, 2),
    stop: Sequence[str] = (),
) -> DataFrame:
    """(topic, term, similarity, rank): candidates by the cosine of term and topic vectors.

    A term's vector is the mean over the texts that hold it, a topic's the mean
    over its texts. Up to ``MAX_LITERAL_TERMS`` candidate terms are looked for
    inside each row; with more of them the terms are exploded and joined.
    """
    candidates = materialize(candidates.select(topic_col, "term"))
    wanted = candidates.select("term").distinct()
    known = [r["term"] for r in wanted.limit(MAX_LITERAL_TERMS + 1).collect()]
    if len(known) <= MAX_LITERAL_TERMS:
        holding = explode_known_terms(docs, text_col, [vec_col], sorted(known), ngrams, stop)
    else:
        every = explode_terms(docs, text_col, [vec_col], ngrams, stop).where("first = 1")
        holding = every.join(wanted, "term", "left_semi")
    term_vectors = mean_vectors(holding, ["term"], vec_col, "term_vector").drop("n")
    topic_vectors = mean_vectors(docs, [topic_col], vec_col, "topic_vector").drop("n")
    compared = lookup_join(
        lookup_join(candidates, term_vectors, ["term"], salts=4), topic_vectors, [topic_col], salts=4
    ).withColumn("similarity", cosine(F.col("term_vector"), F.col("topic_vector")))
    w = Window.partitionBy(topic_col).orderBy(F.desc_nulls_last("similarity"), "term")
    ranked = compared.select(topic_col, "term", "similarity").withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def complaint_features(review_topics: DataFrame, key: str = "url") -> DataFrame:
    """Per entity: most frequent label, distinct labels, non-noise reviews, label -> count.

    Reviews are summed per (entity, label) first; all four features are read off
    those sums.
    """
    counts = (
        not_noise(review_topics)
        .where(F.col(key).isNotNull() & F.col("topic_label").isNotNull())
        .groupBy(key, "topic_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(key).agg(
        F.min_by("topic_label", F.struct(-F.col("n"), "topic_label")).alias("dominant_complaint"),
        F.count(F.lit(1)).cast("int").alias("complaint_diversity"),
        F.sum("n").cast("int").alias("complaint_review_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic_label", "n")))).alias("complaint_topic_counts"),
    )


def fill_complaint_counts(df: DataFrame) -> DataFrame:
    return df.fillna({"complaint_diversity": 0, "complaint_review_count": 0})


def map_topics_to_entities(entities: DataFrame, review_topics: DataFrame, key: str = "url") -> DataFrame:
    return fill_complaint_counts(lookup_join(entities, complaint_features(review_topics, key), [key]))


def topic_report(topics: DataFrame) -> DataFrame:
    """One row: topic count, clustered reviews, noise percent, topic records by frequency."""
    real = F.col("topic_id") != NOISE
    record = F.struct(-F.col("frequency").alias("order"), "topic_id", "topic_label", "frequency", "pct")
    records = F.array_sort(F.collect_list(F.when(real, record)))
    report = topics.agg(
        F.count_if(real).alias("n_topics"),
        F.coalesce(F.sum(F.when(real, F.col("frequency"))), F.lit(0)).alias("n_reviews_clustered"),
        F.coalesce(F.max(F.when(~real, F.col("pct"))), F.lit(0.0)).alias("noise_pct"),
        records.alias("topics"),
    )
    plain = F.transform("topics", lambda t: F.struct(t["topic_id"].alias("topic_id"), t["topic_label"].alias("topic_label"), t["frequency"].alias("frequency"), t["pct"].alias("pct")))
    return report.withColumn("topics", plain)


def topics_for_export(topics: DataFrame) -> DataFrame:
    return topics.withColumn("keywords", join_keywords(F.col("keywords")))


def topic_centroids_2d(points: DataFrame, topic_col: str = "topic_id", min_n: int = 5) -> DataFrame:
    """Mean position of each non-noise topic with enough points."""
    return (
        not_noise(points, topic_col)
        .groupBy(topic_col)
        .agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("points"))
        .where(F.col("points") >= min_n)
    )
