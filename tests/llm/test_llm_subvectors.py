"""Centroid clustering against a plain loop in Python's integers."""

import hashlib
from math import floor, isfinite

import numpy as np
import pytest
from patronvoice.llm import subvectors


def plain(rows, k, rounds, dims, scale=1024, seed="3"):
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            some = [v for (_, v), o in zip(kept, own) if o == j]
            if some:
                centroids[j] = [sum(c) // len(some) for c in zip(*some)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), centroids[c]) for i, c, d in found), key=repr)


def _got(df):
    return sorted(((r[0], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in df.collect()), key=repr)


def _rows(dims, n=240):
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.3, (n, dims)), np.repeat(rng.normal(0, 0.3, (1, dims)), n // 2, axis=0)])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [None, [], [0.1] * (dims - 1), [0.1] * (dims + 1), [None] + [0.1] * (dims - 1), [float("nan")] + [0.1] * (dims - 1), [float("inf")] * dims]
    return rows + [(1000 + i, v) for i, v in enumerate(odd)] + [(None, [0.5] * dims), (3, rows[3][1]), (3, rows[3][1]), (4, [-0.0] * dims)]


@pytest.mark.parametrize("dims,chunk,reuse,parts", [(4, 16, 2, 1), (6, 50, 1, 3), (5, 10_000, 8, 4)])
def test_equals_plain_loop(spark, dims, chunk, reuse, parts):
    rows = _rows(dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    got = _got(subvectors.cluster_subvectors(df, k=5, rounds=6, dims=dims, chunk_rows=chunk, reuse=reuse))
    assert got == plain(rows, 5, 6, dims)


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(-5, 5, (20, 7)), 50, axis=0)
    blocks = subvectors.dictionaries(x, reuse=2)
    assert any(e.shape[1] == 4 for _, e, _ in blocks)
    assert (np.hstack([e[c] for _, e, c in blocks]) == x).all()
    wide = subvectors.dictionaries(rng.integers(-1000, 1000, (200, 6)), reuse=8)
    assert [e.shape[1] for _, e, _ in wide] == [1] * 6


def test_few_equal_or_no_vectors(spark):
    schema = "id long, v array<float>, embedding string"
    rows = [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x"), (3, [-1.5, 0.25], "x")]
    df = spark.createDataFrame(rows, schema)
    got = subvectors.cluster_subvectors(df, "id", "v", k=8, dims=2)
    assert got.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert _got(got) == plain([r[:2] for r in rows], 8, 10, 2)
    none = subvectors.cluster_subvectors(df, "id", "v")
    assert none.columns == got.columns and none.collect() == []
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 0.0])], "id long, v array<double>")
    assert [r["id"] for r in subvectors.cluster_subvectors(huge, "id", "v", dims=2).collect()] == [2]
