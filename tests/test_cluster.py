import numpy as np
import pytest
from patronvoice.operators import neighbours
from patronvoice.operators.cluster import (
    apply_merge,
    cluster_density,
    cluster_kmeans,
    density_components,
    merge_similar_topics,
    star_components,
)
from patronvoice.operators.vectors import assign_topics, mean_vectors, reduce_dimensions


def _points(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>").repartition(parts)


def _blobs(per=60, noise=6):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 5]])
    x = np.concatenate([c + rng.normal(0, 0.15, (per, 3)) for c in centres] + [rng.uniform(100, 900, (noise, 3))])
    return x, np.repeat([0, 1, 2, -1], [per, per, per, noise])


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 1000 + i) for i in range(40)] + [(201 + i, 1000 + i) for i in range(40)]
    parent = {}

    def find(v):
        parent.setdefault(v, v)
        while parent[v] != v:
            v = parent[v]
        return v

    for node, hub in edges:
        parent[find(("h", hub))] = find(("n", node))
    groups = {}
    for node, _ in edges:
        groups.setdefault(find(("n", node)), set()).add(node)
    want = {n: min(g) for g in groups.values() for n in g}
    df = spark.createDataFrame(edges, "node long, hub long")
    assert {r["node"]: r["component"] for r in star_components(df).collect()} == want


def test_blobs_are_found(spark):
    x, truth = _blobs()
    got = cluster_density(_points(spark, x), "id", "vec", eps=1.5, min_samples=5, min_size=15)
    found = {r["id"]: r["topic_id"] for r in got.collect()}
    for label in (0, 1, 2):
        assert len({found[i] for i in np.flatnonzero(truth == label)}) == 1
    assert len({found[i] for i in np.flatnonzero(truth >= 0)}) == 3
    assert {found[i] for i in np.flatnonzero(truth == -1)} == {-1}


def test_small_clusters_become_noise(spark):
    x, truth = _blobs(per=10)
    got = cluster_density(_points(spark, x), "id", "vec", eps=1.5, min_samples=5, min_size=15)
    assert {r["topic_id"] for r in got.collect()} == {-1}


def test_links_are_true_links(spark):
    """Never joins what exact density clustering at eps keeps apart."""
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 6, (150, 2))
    eps, min_samples = 0.7, 4
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    got = {r["id"]: r["component"] for r in density_components(_points(spark, x), "id", "vec", eps, min_samples).collect()}
    clusters = {}
    for i, c in got.items():
        if c is not None:
            clusters.setdefault(c, []).append(i)
            assert near[i][core].any()
    # all links are found, not only true ones
    want = {}
    for i in np.flatnonzero(core):
        want.setdefault(label[i], set()).add(i)
    assert sorted(sorted(i for i in c if core[i]) for c in clusters.values()) == sorted(map(sorted, want.values()))


def _exact(x, eps, min_samples):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= min_samples
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    for i in np.flatnonzero(~core):
        label[i] = min(label[near[i] & core], default=-1)
    return label


@pytest.mark.parametrize("dims,spread,eps", [(2, 0.3, 0.2), (10, 0.05, 0.6), (10, 0.08, 0.6), (10, 0.12, 0.6), (50, 0.1, 1.2)])
def test_equals_brute_force(spark, monkeypatch, dims, spread, eps):
    """Also with many small cells and blocks, and a third of all points in one place."""
    rng = np.random.default_rng(dims)
    centres = rng.uniform(0, 3, (4, dims))
    x = np.concatenate([c + rng.normal(0, spread, (100, dims)) for c in centres] + [centres[0] + rng.normal(0, spread / 9, (200, dims))])
    monkeypatch.setattr(neighbours, "CELL_POINTS", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    got = density_components(_points(spark, x), "id", "vec", eps, 5).collect()
    want = _exact(x, eps, 5)
    assert [(-1 if r["component"] is None else r["component"]) for r in sorted(got)] == want.tolist()


def test_ids_are_dense_and_independent_of_partitions(spark):
    x = np.concatenate([np.full((3 + i % 5, 2), 10.0 * i) for i in range(40)])
    runs = []
    adaptive = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "8"):
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            got = cluster_density(_points(spark, x, int(partitions)), "id", "vec", eps=0.5, min_samples=2, min_size=2)
            runs.append({r["id"]: r["topic_id"] for r in got.collect()})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive[0])
        spark.conf.set("spark.sql.shuffle.partitions", adaptive[1])
    assert runs[0] == runs[1] and set(runs[0].values()) == set(range(40))


def test_odd_vectors(spark):
    rows = [(1, None), (2, []), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.1])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    assert {r["id"]: r["component"] for r in density_components(df, "id", "vec", 0.2, 2).collect()} == {1: None, 2: None, 3: None, 4: None, 5: 5, 6: 5}
    means = {r["id"]: r["topic_id"] for r in cluster_kmeans(df, "vec", 2).collect()}
    assert [means[i] for i in (1, 2, 3, 4)] == [-1] * 4 and means[5] >= 0
    assert cluster_kmeans(df.limit(0), "vec", 2).count() == 0 and cluster_density(df.limit(0), "id", "vec", 0.2).count() == 0
    centroids = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "topic_id long, vector array<double>")
    for chunk in (4096, 1):
        got = assign_topics(df.where("id <> 2 AND id <> 3"), "vec", centroids, chunk=chunk, group_rows=2)
        assert {r["id"]: r["topic_id"] for r in got.collect()} == {1: None, 4: 7, 5: 7, 6: 7}
    assert {r["topic_id"] for r in assign_topics(df, "vec", centroids.limit(0)).collect()} == {None}


@pytest.mark.parametrize("dims", [10, 64])
def test_all_pairs_of_similar_topics_merge(spark, dims):
    rng = np.random.default_rng(dims)
    rows, want = [], {}
    for k in range(50):
        a = rng.standard_normal(dims)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(dims)
        b -= (b @ a) * a
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)).tolist())]
    x = np.array([r[1] for r in rows])
    label = _exact(x, np.sqrt(2 - 2 * 0.9), 1)
    want = {i: int(c) for i, c in enumerate(label)}
    merged = merge_similar_topics(spark.createDataFrame(rows, "topic_id long, vec array<double>"), "topic_id", "vec", tau=0.9)
    got = {r["topic_id"]: r["merged"] for r in merged.collect()}
    assert got == want and all(got[2 * k] == got[2 * k + 1] for k in range(50))


def test_copies_and_partitioning(spark):
    x, _ = _blobs()
    x = np.concatenate([x, np.repeat(x[:1], 200, axis=0)])  # more than half are copies of one point
    runs = []
    for parts in (1, 8):
        df = cluster_density(_points(spark, x, parts), "id", "vec", eps=1.5, min_samples=5, min_size=15)
        rows = {r["id"]: r["topic_id"] for r in df.collect()}
        groups = {}
        for i, t in rows.items():
            groups.setdefault(t, set()).add(i)
        runs.append(sorted(map(sorted, groups.values())))
        assert len({rows[i] for i in range(len(x) - 200, len(x))} | {rows[0]}) == 1
    assert runs[0] == runs[1]


def test_merge_joins_close_topics(spark):
    rng = np.random.default_rng(4)
    centres = {0: [1, 0, 0], 1: [0.995, 0.05, 0], 2: [0, 1, 0], -1: [0, 0, 1]}
    rows = [(t, [float(v) for v in np.array(c) + rng.normal(0, 0.01, 3)]) for t, c in centres.items() for _ in range(20)]
    df = spark.createDataFrame(rows, "topic_id long, vec array<double>")
    merged = merge_similar_topics(df, "topic_id", "vec", tau=0.9)
    assert {r["topic_id"]: r["merged"] for r in merged.collect()} == {0: 0, 1: 0, 2: 2}
    counts = {r["topic_id"]: r["count"] for r in apply_merge(df, merged, "topic_id").groupBy("topic_id").count().collect()}
    assert counts == {0: 40, 2: 20, -1: 20}


def test_kmeans_and_assignment(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.array(c) + rng.normal(0, 0.05, (30, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1])])
    got = cluster_kmeans(_points(spark, x), "vec", 3, seed=1)
    labels = {r["id"]: r["topic_id"] for r in got.collect()}
    assert [len({labels[i] for i in range(a, a + 30)}) for a in (0, 30, 60)] == [1, 1, 1]
    centroids = mean_vectors(got, ["topic_id"], "vec")
    for chunk in (4096, 1):
        again = assign_topics(_points(spark, x), "vec", centroids, chunk=chunk)
        assert {r["id"]: r["topic_id"] for r in again.collect()} == labels


def test_reduction_keeps_the_spread(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (80, 6)) * [5, 3, 0.01, 0.01, 0.01, 0.01]
    got = reduce_dimensions(_points(spark, x), "vec", 2).orderBy("id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    _, _, vt = np.linalg.svd(unit - unit.mean(0))
    want = unit @ vt[:2].T
    have = np.array([r["reduced"] for r in got.collect()])
    assert np.abs(have) == pytest.approx(np.abs(want), abs=1e-6)


def test_points_are_placed_once_whatever_the_radius(spark, monkeypatch):
    """A wide radius makes more blocks meet, not more or wider rows; nothing near is missed, copies count."""
    monkeypatch.setattr(neighbours, "CELL_POINTS", 40)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    x = np.random.default_rng(3).normal(0, 1, (300, 3))
    rows = [(i, 1 + i % 3, [float(v) for v in p]) for i, p in enumerate(x)]
    points = spark.createDataFrame(rows, "node long, n long, vec array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for eps in (0.3, 50.0):
        placed = neighbours.blocks(points, eps)
        assert placed.rows.count() == 300 and placed.sizes.max() <= 60
        got = {r["node"]: r["count"] for r in neighbours.neighbour_counts(placed, eps).collect()}
        want = (d <= eps) @ (1 + np.arange(300) % 3)
        assert [got[i] for i in range(300)] == want.tolist()
    assert not neighbours.blocks(points, 0.3).near.all()


@pytest.mark.parametrize("dims,spread,eps", [(2, 0.3, 0.2), (3, 0.3, 0.35), (5, 0.2, 0.6)])
def test_dense_points_are_linked_by_cell(spark, monkeypatch, dims, spread, eps):
    """Cells of a grid are compared in place of points, and not again once they hang together; rows are those of brute force."""
    rng = np.random.default_rng(dims)
    centres = rng.uniform(0, 3, (4, dims))
    x = np.concatenate([c + rng.normal(0, spread, (150, dims)) for c in centres] + [centres[0] + rng.normal(0, spread / 9, (600, dims)), rng.uniform(-1, 4, (60, dims))])
    monkeypatch.setattr(neighbours, "CELL_POINTS", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    want = _exact(x, eps, 5)
    for dense in (0, neighbours.DENSE):  # 0: cells in every task, however few points they hold
        monkeypatch.setattr(neighbours, "DENSE", dense)
        got = density_components(_points(spark, x), "id", "vec", eps, 5).collect()
        assert [(-1 if r["component"] is None else r["component"]) for r in sorted(got)] == want.tolist()


def test_dense_points_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (8_000, 2))
    points = spark.createDataFrame([(i, 1, [float(v) for v in p]) for i, p in enumerate(x)], "node long, n long, vec array<double>")
    count, whole = spark.sparkContext.accumulator(0), neighbours.within

    def within(a, b, eps):
        count.add(len(a) * len(b))
        return whole(a, b, eps)

    monkeypatch.setattr(neighbours, "within", within)
    got = density_components(points.withColumnRenamed("node", "id"), "id", "vec", 0.2, 5)
    assert got.where("component = 0").count() == len(x) and 0 < count.value < len(x) ** 2 / 8


def test_a_grid_cell_may_lie_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_POINTS", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    x = np.array([0.3, 0.3]) + np.random.default_rng(2).uniform(0, 0.01, (600, 2))
    got = density_components(_points(spark, x), "id", "vec", 1.0, 5)
    assert {r["component"] for r in got.collect()} == {0}
