"""Queries whose result comes from a fitted model or an iteration; checked by row count and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronvoice.operators import agglomerate, cluster, hierarchy, latent
from patronvoice.operators import terms as terms_ops
from patronvoice.operators import topics as topic_ops
from patronvoice.operators import vectors
from patronvoice.operators.scorers import score_sentiment, train_scorer
from patronvoice.plans.topics import TopicParams, complaint_topics, fit_topics, topic_map_2d
from patronvoice.session import materialize
from registry.base import r6, register
from registry.topics import doc_entities

_PARAMS = TopicParams(dims=5, eps=0.15, min_samples=3, min_size=8, embed_dims=64)


@register("score_sentiment")
def _(t):
    labelled = t.documents.join(t.read("labels"), "doc_id").withColumn(
        "label", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    )
    scorer = train_scorer(labelled, "text", "label", features=1 << 14, max_iter=10)
    got = score_sentiment(t.documents.select("doc_id", "text"), "text", scorer)
    return got.select("doc_id", "raw_label", "sentiment")


@register("embed_texts")
def _(t):
    got = vectors.embed_texts(t.documents.select("doc_id", "text"), "text", dims=64)
    return got.select("doc_id", "embedding")


@register("latent_vectors")
def _(t):
    texts = t.documents.select("doc_id", "text")
    return latent.fit_latent(texts, "text", 64).transform(texts, "text").select("doc_id", "embedding")


@register("reduce_dimensions")
def _(t):
    got = vectors.reduce_dimensions(t.read("embeddings"), "embedding", 10)
    return got.select("vec_id", "reduced")


_EPS, _MIN_SAMPLES, _MIN_SIZE = 1.1, 3, 3
_DENSITY_SQL = f"""
WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON list_distance(a.v, b.v) <= {_EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {_MIN_SAMPLES}),
link AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY a),
border AS (SELECT n.a AS id, min(k.c) AS c FROM near n JOIN comp k ON n.b = k.id GROUP BY n.a),
every AS (SELECT p.id, coalesce(comp.c, border.c) AS c FROM p LEFT JOIN comp ON p.id = comp.id LEFT JOIN border ON p.id = border.id),
ids AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c) - 1 AS topic_id FROM every WHERE c IS NOT NULL GROUP BY c HAVING count(*) >= {_MIN_SIZE})
SELECT every.id AS vec_id, coalesce(topic_id, -1) AS topic_id FROM every LEFT JOIN ids ON every.c = ids.c
"""


@register("cluster_density", _DENSITY_SQL)
def _(t):
    got = cluster.cluster_density(t.read("embeddings"), "vec_id", "embedding", _EPS, _MIN_SAMPLES, _MIN_SIZE)
    return got.select("vec_id", "topic_id")


@register("cluster_hierarchy")
def _(t):
    return hierarchy.cluster_hierarchy(t.read("embeddings"), "vec_id", "embedding").select("vec_id", "topic_id")


@register("cluster_kmeans")
def _(t):
    return cluster.cluster_kmeans(t.read("embeddings"), "embedding", 8).select("vec_id", "topic_id")


@register(
    "mean_vectors",
    "SELECT label, count(*) AS n, round_even(avg(CAST(embedding[1] AS DOUBLE)) * 1000000e0, 0) / 1000000e0 AS first FROM embeddings GROUP BY 1",
)
def _(t):
    means = vectors.mean_vectors(t.read("embeddings"), ["label"], "embedding")
    return means.select("label", "n", r6(F.col("vector")[0]).alias("first"))


_CENTROIDS = (
    "each AS (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), "
    "mean AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM each GROUP BY label, i), "
    "size AS (SELECT label, sqrt(sum(v * v)) AS s FROM mean GROUP BY label)"
)


@register(
    "assign_topics",
    f"WITH {_CENTROIDS}, c AS (SELECT vec_id, mean.label, sum(CAST(embedding[mean.i] AS DOUBLE) * v) AS dot FROM each JOIN mean ON each.i = mean.i GROUP BY vec_id, mean.label) "
    "SELECT vec_id, CAST(first(c.label ORDER BY dot / s DESC, c.label) AS BIGINT) AS topic_id FROM c JOIN size ON c.label = size.label GROUP BY vec_id",
)
def _(t):
    embeddings = t.read("embeddings")
    centroids = vectors.mean_vectors(embeddings, ["label"], "embedding")
    got = vectors.assign_topics(embeddings, "embedding", centroids, id_col="label", out_col="topic_id")
    return got.select("vec_id", "topic_id")


_TAU = 0.21


@register(
    "merge_similar_topics",
    f"WITH RECURSIVE {_CENTROIDS}, near AS (SELECT a.label AS a, b.label AS b FROM mean a JOIN mean b ON a.i = b.i JOIN size x ON x.label = a.label JOIN size y ON y.label = b.label "
    f"GROUP BY a.label, b.label, x.s, y.s HAVING sum(a.v * b.v) / x.s / y.s >= {_TAU}), "
    "reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a) "
    "SELECT a AS topic_id, min(b) AS merged FROM reach GROUP BY a",
)
def _(t):
    return cluster.merge_similar_topics(t.read("embeddings").withColumnRenamed("label", "topic_id"), "topic_id", "embedding", tau=_TAU)


@register("merge_by_average_link")
def _(t):
    docs = t.documents.withColumn("topic_id", F.crc32(F.concat_ws("/", "lang", "source").cast("binary")))
    weights = terms_ops.class_tfidf(terms_ops.term_counts(docs, "text", "topic_id", (1, 1)), "topic_id")
    return agglomerate.merge_by_average_link(weights, "topic_id")


@register("rerank_keywords")
def _(t):
    docs = materialize(vectors.embed_texts(t.documents.select("doc_id", "lang", "text"), "text", dims=64))
    weights = terms_ops.class_tfidf(terms_ops.term_counts(docs, "text", "lang", (1, 1)), "lang")
    candidates = terms_ops.top_terms(weights, "lang", 30)
    best = topic_ops.rerank_keywords(candidates, docs, "text", "embedding", "lang", 10, (1, 1))
    return best.select("lang", "rank", "term")


@register("topic_map_2d")
def _(t):
    docs = t.read("embeddings").withColumn("topic_id", F.col("label").cast("bigint"))
    return topic_map_2d(docs, "vec_id", "embedding")


@register(
    "topic_centroids_2d",
    "SELECT CAST(label AS BIGINT) AS topic_id, round_even(avg(CAST(embedding[1] AS DOUBLE)) * 1000000e0, 0) / 1000000e0 AS x, "
    "round_even(avg(CAST(embedding[2] AS DOUBLE)) * 1000000e0, 0) / 1000000e0 AS y, count(*) AS points FROM embeddings GROUP BY 1 HAVING count(*) >= 5",
)
def _(t):
    vec = F.col("embedding").cast("array<double>")
    points = t.read("embeddings").select(F.col("label").cast("bigint").alias("topic_id"), vec[0].alias("x"), vec[1].alias("y"))
    return topic_ops.topic_centroids_2d(points).select("topic_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "points")


@register("fit_topics")
def _(t):
    reviews = t.documents.select(F.col("doc_id").alias("review_id"), F.col("text").alias("review_text"))
    assigned, _ = fit_topics(reviews, params=_PARAMS)
    return assigned.select("review_id", "topic_id", "topic_label")


@register("complaint_topics")
def _(t):
    entities, _, _ = complaint_topics(doc_entities(t), _PARAMS)
    return entities.select("url", "dominant_complaint", "complaint_diversity", "complaint_review_count")
