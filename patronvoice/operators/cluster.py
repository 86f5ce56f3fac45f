"""Density clustering on exact neighbours.

A point with ``min_samples`` points within ``eps`` (itself and copies included) is
a core point; clusters are the connected components of core points within ``eps``
of each other, and any other point joins the cluster of a core point within
``eps`` or is noise. Neighbours come from ``operators.neighbours``, which finds all
of them; copies of a point are folded into one node, and links travel as forests:
a task gives at most a row per point that it meets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronvoice.operators.joins import lookup_join
from patronvoice.operators.neighbours import blocks, core_links, neighbour_counts
from patronvoice.operators.vectors import mean_vectors
from patronvoice.session import ensure_checkpoint_dir, materialize

NOISE = -1
_SALTS = 4  # lookups are about as long as what they join; adaptive execution splits further


def star_components(edges: DataFrame, node: str = "node", hub: str = "hub") -> DataFrame:
    """(node, component) of the graph whose edges tie nodes to hubs.

    Each round every node hooks onto the smallest node it shares a hub with, the
    chains are followed to their ends, and the graph shrinks to those ends; at
    least half of the connected nodes vanish per round. The tables of a round
    are checkpointed.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.col(node).alias("node"), F.col(hub).alias("hub")).distinct().checkpoint()
    mapping = edges.select("node", F.col("node").alias("component")).distinct()
    while True:
        smallest = edges.groupBy("hub").agg(F.min("node").alias("first"))
        hooks = (
            lookup_join(edges, smallest, ["hub"], _SALTS)
            .groupBy("node")
            .agg(F.min("first").alias("root"))
            .where(F.col("root") < F.col("node"))
            .checkpoint()
        )
        if hooks.isEmpty():
            return mapping
        hooks = _follow(hooks)
        mapping = _replace(mapping, hooks, "component").checkpoint()
        edges = _replace(edges, hooks, "node").distinct().checkpoint()


def _replace(df: DataFrame, hooks: DataFrame, col: str) -> DataFrame:
    target = hooks.select(F.col("node").alias(col), F.col("root").alias("_to"))
    return lookup_join(df, target, [col], _SALTS).withColumn(col, F.coalesce("_to", col)).drop("_to")


def _follow(hooks: DataFrame) -> DataFrame:
    """Point every node at the end of its chain; each jump doubles the distance."""
    while True:
        hooks = _jump(_jump(hooks)).checkpoint()
        # whoever still points at a hooked node has not arrived
        on_the_way = hooks.join(hooks.select(F.col("node").alias("root")), "root", "left_semi")
        if on_the_way.isEmpty():
            return hooks


def _jump(hooks: DataFrame) -> DataFrame:
    target = hooks.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return lookup_join(hooks, target, ["root"], _SALTS).select("node", F.coalesce("_to", "root").alias("root"))


def density_components(points: DataFrame, id_col: str, vec_col: str, eps: float, min_samples: int) -> DataFrame:
    """(id, component); component is the smallest id among the cluster's core points.

    Null for noise, and for vectors that are null, empty or not finite. A point
    near core points of several clusters joins the one with the smallest component.
    """
    fine = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = materialize(points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")))
    folded = rows.where(fine).groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    nodes = materialize(folded.withColumn("node", F.monotonically_increasing_id()))
    if nodes.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(None).cast(rows.schema["id"].dataType).alias("component"))
    placed = blocks(nodes, eps)
    counts = materialize(neighbour_counts(placed, eps, min_samples).select("node", (F.col("count") >= min_samples).alias("core")))
    linked = materialize(core_links(replace(placed, rows=materialize(lookup_join(placed.rows, counts, ["node"]))), eps))
    # every core point is its own neighbour, so all of them are in here
    core = lookup_join(star_components(linked.where("core")), nodes.select("node", "first"), ["node"])
    names = materialize(core.groupBy("component").agg(F.min("first").alias("name")))
    core = materialize(lookup_join(core, names, ["component"], _SALTS).select("node", "name"))
    near = linked.where("NOT core").select("node", F.col("hub").alias("to"))
    border = near.join(core.select(F.col("node").alias("to"), "name"), "to").groupBy("node").agg(F.min("name").alias("near"))
    by_node = lookup_join(lookup_join(nodes, core, ["node"]), border, ["node"])
    by_vec = by_node.select("vec", F.coalesce("name", "near").alias("component"))
    return lookup_join(rows, by_vec, ["vec"], _SALTS).select(F.col("id").alias(id_col), "component")


def dense_numbers(df: DataFrame, order: Sequence[Column | str], out_col: str) -> DataFrame:
    """``df`` sorted by ``order`` with numbers from 0 without gaps, whatever the partitions.

    Only one count per sorted partition meets in one place.
    """
    ranked = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))
    numbered = lookup_join(ranked.withColumn("_part", part), offsets, ["_part"])
    return numbered.withColumn(out_col, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_part", "_before")


def number_clusters(assigned: DataFrame, min_size: int, out_col: str) -> DataFrame:
    """Cluster ids by falling size from 0; small clusters become noise.

    Equal sizes are ordered by component; the ids do not depend on partitions.
    """
    sizes = (
        assigned.where(F.col("component").isNotNull())
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") >= min_size)
    )
    ids = dense_numbers(sizes, [F.desc("size"), "component"], "_cluster").select("component", "_cluster")
    return (
        lookup_join(assigned, ids, ["component"], _SALTS)
        .withColumn(out_col, F.coalesce("_cluster", F.lit(NOISE).cast("bigint")))
        .drop("component", "_cluster")
    )


def cluster_density(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    eps: float,
    min_samples: int = 5,
    min_size: int = 15,
    out_col: str = "topic_id",
) -> DataFrame:
    """``df`` with a cluster id per row, -1 for noise. ``id_col`` is unique."""
    found = density_components(df, id_col, vec_col, eps, min_samples)
    return lookup_join(df, number_clusters(found, min_size, out_col), [id_col])


def cluster_kmeans(df: DataFrame, vec_col: str, k: int, seed: int = 42, out_col: str = "topic_id") -> DataFrame:
    """The same output from cosine k-means; null and zero vectors, which have no direction, are noise."""
    vec = F.col(vec_col).cast("array<double>")
    rows = df.withColumn("_usable", F.coalesce(F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)))
    known = rows.where("_usable").withColumn("_vec", array_to_vector(vec))
    noise = F.lit(NOISE).cast("bigint").alias(out_col)
    others = rows.where("NOT _usable").select(*df.columns, noise)
    if known.isEmpty():
        return df.select(*df.columns, noise)
    model = Pipeline(stages=[KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="_vec", predictionCol="_k")]).fit(known)
    return model.transform(known).select(*df.columns, F.col("_k").cast("bigint").alias(out_col)).union(others)


def merge_similar_topics(df: DataFrame, topic_col: str, vec_col: str, tau: float = 0.9) -> DataFrame:
    """(topic, merged): topics whose centroids reach a cosine of ``tau`` get one id, the smallest.

    Unit vectors with that cosine are sqrt(2 - 2 tau) apart; the neighbour search
    of the clustering finds all such pairs. Topics without a direction stay alone.
    """
    centroids = materialize(mean_vectors(df.where(F.col(topic_col) != NOISE), [topic_col], vec_col))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    unit = centroids.withColumn("_length", length).where("_length > 0").select(
        topic_col, F.transform("vector", lambda x: x / F.col("_length")).alias("vector")
    )
    # a hair wider than the bound, as the square root is rounded
    linked = density_components(unit, topic_col, "vector", float(np.sqrt(max(0.0, 2 - 2 * tau))) + 1e-9, 1)
    merged = lookup_join(centroids.select(topic_col), linked, [topic_col])
    return merged.select(topic_col, F.coalesce("component", topic_col).alias("merged"))


def apply_merge(df: DataFrame, merged: DataFrame, topic_col: str) -> DataFrame:
    return (
        lookup_join(df, merged, [topic_col], _SALTS)
        .withColumn(topic_col, F.coalesce("merged", topic_col))
        .drop("merged")
    )
