"""Topics merged by average link over their term weights.

Two groups of topics are as similar as their members are on average: the sum of
the cosines of all pairs, over the number of pairs. Only those sums are kept. In
each round every group picks the most similar other one, and groups that pick each
other merge; under average link no later merge can come between such a pair, so
the result is that of merging the best pair again and again. A round is a few
aggregates over the table of sums, which shrinks with the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.operators.cluster import NOISE, star_components
from patronvoice.operators.joins import lookup_join
from patronvoice.session import materialize

_TOPICS = 512  # topics in a block; pairs of blocks are compared
_CELLS = 1 << 18  # weights of a pair of blocks that one task holds with their terms, about
_TERMS = 4096  # terms in a dense slice of a block


def _blocks_to_dots(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums of products over the terms of one group: topics of one block with those of another, or of the same."""
    columns = ["a", "b", "dot"]
    left, right = (frame[frame["side"] == s] for s in (0, 1))
    if left.empty or right.empty:
        return pd.DataFrame([], columns=columns)
    terms = pd.factorize(frame["term"])[0]
    rows = [np.unique(side["node"].to_numpy(), return_inverse=True) for side in (left, right)]
    total = np.zeros((len(rows[0][0]), len(rows[1][0])))
    codes = [terms[(frame["side"] == s).to_numpy()] for s in (0, 1)]
    for at in range(0, int(terms.max()) + 1, _TERMS):
        dense = []
        for side, (names, place), code in zip((left, right), rows, codes):
            here = (code >= at) & (code < at + _TERMS)
            x = np.zeros((len(names), _TERMS))
            x[place[here], code[here] - at] = side["unit"].to_numpy()[here]
            dense.append(x)
        total += dense[0] @ dense[1].T
    i, j = np.nonzero(total)
    a, b = rows[0][0][i], rows[1][0][j]
    keep = (a < b) if frame["p"].iloc[0] == frame["q"].iloc[0] else slice(None)
    found = {"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "dot": total[i, j][keep]}
    return pd.DataFrame(found, columns=columns)


def topic_cosines(units: DataFrame, topics: int) -> DataFrame:
    """(a, b, dot), a < b: the cosines of topics, as far as not 0; ``units`` has unit vectors as (node, term, unit).

    Topics lie in blocks by hash; a block meets each block once, by itself or, for
    many terms, in parts of its terms.
    """
    blocks = max(1, -(-topics // _TOPICS))
    chunks = max(1, -(-2 * units.count() // (blocks * _CELLS)))
    own = F.pmod(F.xxhash64("node"), F.lit(blocks))
    # the left side of the pairs with itself and with later blocks, the right side of those with itself and earlier ones
    pairs = F.concat(
        F.transform(F.sequence(own, F.lit(blocks - 1).cast("bigint")), lambda o: F.struct(own.alias("p"), o.alias("q"), F.lit(0).alias("side"))),
        F.transform(F.sequence(F.lit(0).cast("bigint"), own), lambda o: F.struct(o.alias("p"), own.alias("q"), F.lit(1).alias("side"))),
    )
    sent = units.select("node", "term", "unit", F.explode(pairs).alias("k"))
    sent = sent.select("node", "term", "unit", "k.*", F.pmod(F.xxhash64("term"), F.lit(chunks)).alias("chunk"))
    parts = sent.groupBy("p", "q", "chunk").applyInPandas(_blocks_to_dots, "a bigint, b bigint, dot double")
    return parts.groupBy("a", "b").agg(F.sum("dot").alias("dot"))


def _lookup(df: DataFrame, groups: DataFrame, end: str, take: str) -> DataFrame:
    return df.join(groups.select(F.col("node").alias(end), F.col(take).alias(f"{take}_{end}")), end)


def merges(dots: DataFrame, nodes: DataFrame, tau: float = 0.0) -> DataFrame:
    """(a, b, similarity, round): group b joins group a < b; groups are named by their smallest member.

    ``nodes`` has (node, size). Merges below ``tau``, and of groups that share nothing, are left out.
    """
    spark = dots.sparkSession
    sums, sizes = materialize(dots), nodes
    found = spark.createDataFrame([], "a bigint, b bigint, similarity double, round int")
    number = 0
    while True:
        sized = _lookup(_lookup(sums, sizes, "a", "size"), sizes, "b", "size")
        near = sized.select("a", "b", (F.col("dot") / F.col("size_a") / F.col("size_b")).alias("similarity")).where(F.col("similarity") >= tau)
        pick = F.struct((-F.col("similarity")).alias("far"), "a", "b")
        picks = near.select(F.explode(F.array("a", "b")).alias("node"), pick.alias("pick")).groupBy("node").agg(F.min("pick").alias("pick"))
        both = picks.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        now = materialize(both.select("pick.a", "pick.b", (-F.col("pick.far")).alias("similarity"), F.lit(number).alias("round")))
        if now.isEmpty():
            return found
        found = found.union(now)
        to = sizes.join(now.select(F.col("b").alias("node"), F.col("a").alias("to")), "node", "left")
        to = materialize(to.select("node", "size", F.coalesce("to", "node").alias("to")))
        moved = _lookup(_lookup(sums, to, "a", "to"), to, "b", "to").where("to_a <> to_b")
        moved = moved.groupBy(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).agg(F.sum("dot").alias("dot"))
        sums = materialize(moved)
        sizes = to.groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("size"))
        number += 1


def _kept(found: DataFrame, topics: int, count: int | None, gap: bool) -> DataFrame:
    """The most similar merges: down to ``count`` topics, or above the widest gap between two that follow each other."""
    # one row per merge, fewer than there are topics
    order = [F.desc("similarity"), F.col("round"), F.col("a"), F.col("b")]
    if count is not None:
        return found.orderBy(*order).limit(max(0, topics - count))
    if not gap:
        return found
    steps = found.select("similarity").orderBy(*order[:1]).toPandas()["similarity"].to_numpy()
    if len(steps) < 2:
        return found
    return found.where(F.col("similarity") >= float(steps[int(np.argmax(steps[:-1] - steps[1:]))]))


def merge_by_average_link(
    weights: DataFrame, topic_col: str, count: int | None = None, tau: float | None = None, term_col: str = "term", weight_col: str = "weight"
) -> DataFrame:
    """(topic, merged): each topic of ``weights`` and the smallest topic of its group.

    ``count`` asks for so many groups, ``tau`` merges while groups are that similar
    on average; without either, merging stops at the widest gap between the
    similarities of successive merges. Ties go to the smaller ids. Topics that share
    no term never merge, so more than ``count`` may be left. The noise topic,
    null topics and null terms are left out; weights of one term are added up; a
    topic whose weights are all 0 or null stays alone. Ids are integers.
    """
    if count is not None and tau is not None:
        raise ValueError("give count or tau, not both")
    rows = weights.select(F.col(topic_col).cast("bigint").alias("node"), F.col(term_col).alias("term"), F.col(weight_col).cast("double").alias("w"))
    rows = rows.where(F.col("node").isNotNull() & (F.col("node") != NOISE))
    summed = materialize(rows.groupBy("node", "term").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")))
    length = summed.where(F.col("term").isNotNull()).groupBy("node").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    topics = materialize(summed.select("node").distinct())
    units = summed.where(F.col("term").isNotNull() & (F.col("w") != 0)).join(length, "node")
    units = materialize(units.select("node", "term", (F.col("w") / F.col("length")).alias("unit")))
    number = topics.count()
    found = merges(topic_cosines(units, number), topics.withColumn("size", F.lit(1).cast("bigint")), tau or 0.0)
    kept = materialize(_kept(found, number, count, count is None and tau is None))
    # a group is absorbed once, so its name tells the merge
    ends = kept.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("hub"))
    groups = lookup_join(topics, star_components(ends), ["node"])
    return groups.select(F.col("node").alias(topic_col), F.coalesce("component", "node").alias("merged"))
