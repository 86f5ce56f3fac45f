"""Negative reviews to complaint topics and per-entity complaint features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.functions import clean_review_text, has_min_tokens
from patronvoice.operators import terms as terms_ops
from patronvoice.operators.agglomerate import merge_by_average_link
from patronvoice.operators.cluster import apply_merge, cluster_density, cluster_kmeans, merge_similar_topics
from patronvoice.operators.joins import lookup_join
from patronvoice.operators.latent import fit_latent
from patronvoice.operators.sentiment import explode_reviews
from patronvoice.operators.topics import (
    label_topics,
    map_topics_to_entities,
    not_noise,
    rerank_keywords,
    topic_report,
    topic_summary,
    topics_for_export,
)
from patronvoice.operators.vectors import embed_texts, reduce_dimensions
from patronvoice.session import materialize
from patronvoice.sources.fixed import TAXONOMY
from patronvoice.sources.readers import read_sentiment
from patronvoice.sources.writers import write_table


@dataclass(frozen=True)
class TopicParams:
    method: str = "density"  # or "kmeans"
    dims: int = 10
    eps: float = 0.6
    min_samples: int = 5
    min_size: int = 15
    k: int = 8
    merge_tau: float | None = 0.9  # None: topics are not merged (average link: down to merge_count, or the widest gap)
    merge_link: str = "single"  # or "average", over the topics' terms instead of their vectors
    merge_count: int | None = None  # with average link, the number of topics wanted
    embedding: str = "latent"  # or "hashed", which is cheaper and wants 256 and more dimensions
    embed_dims: int = 64
    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 5
    max_df: float = 0.90
    max_features: int | None = None
    stop: Sequence[str] | None = None  # None: the English list
    top_n_words: int = 10
    candidates: int = 30
    rerank: bool = True
    taxonomy: Sequence[tuple[str, Sequence[str]]] = TAXONOMY
    seed: int = 42


def _with_stop_words(params: TopicParams) -> TopicParams:
    return params if params.stop is not None else replace(params, stop=terms_ops.stop_words())


def min_token_filter(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    return df.where(has_min_tokens(F.col(col), n))


def negative_entity_reviews(
    entities: DataFrame,
    level: str = "entity",
    key: str = "url",
    list_col: str = "review_texts",
    min_tokens: int = 5,
) -> DataFrame:
    """Cleaned texts to cluster: key, position, text.

    ``entity`` takes every review of an entity whose dominant sentiment is
    negative; ``review`` takes single reviews from a table that has one row per
    review and a ``sentiment``. Without any such text all texts are taken.
    """
    if level == "entity":
        flag = "dominant_sentiment"
        rows = explode_reviews(entities, key, list_col, carry=(flag,))
    elif level == "review":
        flag = "sentiment"
        rows = entities
    else:
        raise ValueError(f"level must be entity or review, not {level!r}")
    others = [c for c in rows.columns if c != "review_text"]
    # exploded from an array of one: a filter on the cleaned text cannot slip below
    # and make Spark clean every text twice
    once = F.explode(F.array(clean_review_text(F.col("review_text")))).alias("review_text")
    cleaned = rows.select(*others, once).transform(min_token_filter, "review_text", min_tokens)
    if flag not in cleaned.columns:
        return cleaned
    negative = F.col(flag) == "negative"
    found = cleaned.where(negative).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return cleaned.where(negative | ~found).drop("dominant_sentiment")


def fit_topics(
    reviews: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    params: TopicParams = TopicParams(),
    vec_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(reviews with topic id and label, topic table).

    ``vec_col`` names an embedding the reviews already have; otherwise texts are
    embedded here. Vectors, clustered reviews and topics each feed several later
    steps, so each is written once.
    """
    p = _with_stop_words(params)
    if vec_col:
        vectors = reviews.select(id_col, F.col(vec_col).alias("embedding"))
    else:
        texts = reviews.select(id_col, text_col)
        if p.embedding == "latent":
            embedded = fit_latent(texts, text_col, p.embed_dims, p.stop).transform(texts, text_col)
        elif p.embedding == "hashed":
            embedded = embed_texts(texts, text_col, p.embed_dims, stop=p.stop)
        else:
            raise ValueError(f"embedding must be latent or hashed, not {p.embedding!r}")
        vectors = materialize(embedded.select(id_col, "embedding"))
    reduced = reduce_dimensions(vectors, "embedding", p.dims).drop("embedding")
    if p.method == "kmeans":
        clusters = cluster_kmeans(reduced, "reduced", p.k, p.seed)
    else:
        clusters = cluster_density(reduced, id_col, "reduced", p.eps, p.min_samples, p.min_size)
    if p.merge_link == "average":
        clusters = materialize(clusters)
        texts = lookup_join(reviews.select(id_col, text_col), clusters.select(id_col, "topic_id"), [id_col])
        counts = terms_ops.term_counts(not_noise(texts), text_col, "topic_id", p.ngrams, p.min_df, p.max_df, p.max_features, p.stop)
        weights = terms_ops.class_tfidf(counts, "topic_id")
        merged = merge_by_average_link(weights, "topic_id", p.merge_count, None if p.merge_count is not None else p.merge_tau)
        clusters = apply_merge(clusters, merged, "topic_id")
    elif p.merge_link != "single":
        raise ValueError(f"merge_link must be single or average, not {p.merge_link!r}")
    elif p.merge_tau is not None:
        merged = merge_similar_topics(clusters, "topic_id", "reduced", p.merge_tau)
        clusters = apply_merge(clusters, merged, "topic_id")
    clustered = materialize(lookup_join(reviews, clusters, [id_col]))
    topics = materialize(topic_table(clustered, text_col, "reduced", p))
    return label_topics(clustered.drop("reduced"), topics), topics


def topic_table(
    docs: DataFrame, text_col: str, vec_col: str | None, params: TopicParams, topic_col: str = "topic_id"
) -> DataFrame:
    """Keywords, labels and frequencies of texts whose topic is known."""
    p = _with_stop_words(params)
    # the weights read the counts three times
    counts = materialize(terms_ops.term_counts(docs, text_col, topic_col, p.ngrams, p.min_df, p.max_df, p.max_features, p.stop))
    weights = terms_ops.class_tfidf(counts, topic_col)
    if p.rerank and vec_col:
        candidates = terms_ops.top_terms(weights, topic_col, p.candidates)
        best = rerank_keywords(candidates, docs, text_col, vec_col, topic_col, p.top_n_words, p.ngrams, p.stop)
        keywords = terms_ops.top_keywords(best, topic_col, p.top_n_words, by="similarity")
    else:
        keywords = terms_ops.top_keywords(weights, topic_col, p.top_n_words)
    return topic_summary(docs, keywords, topic_col, p.taxonomy)


def complaint_topics(
    entities: DataFrame,
    params: TopicParams = TopicParams(),
    key: str = "url",
    list_col: str = "review_texts",
    scored_reviews: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities with complaint features, review topics, topic table).

    With ``scored_reviews`` the review topics also carry each review's sentiment.
    """
    texts = negative_entity_reviews(entities, key=key, list_col=list_col)
    if scored_reviews is not None:
        texts = lookup_join(texts, scored_reviews.select(key, "review_pos", "sentiment"), [key, "review_pos"])
    # every step reads the texts again
    texts = materialize(texts.withColumn("review_id", F.concat_ws("#", F.col(key), F.col("review_pos"))))
    review_topics, topics = fit_topics(texts, params=params)
    return map_topics_to_entities(entities, review_topics, key), review_topics, topics


def topic_map_2d(
    docs: DataFrame, key: str, vec_col: str, topic_col: str = "topic_id", n: int | None = None
) -> DataFrame:
    """(key, topic, x, y) of all rows, or of the first ``n`` by key."""
    sample = docs.select(key, topic_col, vec_col)
    if n is not None:
        sample = sample.orderBy(key).limit(n)
    flat = reduce_dimensions(sample, vec_col, 2, "_xy")
    return flat.select(key, topic_col, F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))


def run_topics(
    spark: SparkSession, sentiment_path: str, out_dir: str, params: TopicParams = TopicParams(), key: str = "url", min_texts: int = 50
) -> tuple[DataFrame, DataFrame]:
    entities, review_topics, topics = complaint_topics(read_sentiment(spark, sentiment_path), params, key)
    write_table(review_topics, f"{out_dir}/review_topics")
    write_table(topics, f"{out_dir}/topics")
    texts = spark.read.parquet(f"{out_dir}/review_topics").count()
    if texts < min_texts:
        import warnings

        warnings.warn(f"only {texts} texts: topics need about {min_texts}", stacklevel=2)
    write_table(entities, f"{out_dir}/entities")
    write_table(topics_for_export(topics), f"{out_dir}/topics_csv", "csv")
    write_table(topic_report(topics), f"{out_dir}/topic_report", "json")
    return spark.read.parquet(f"{out_dir}/entities"), not_noise(spark.read.parquet(f"{out_dir}/topics"))
