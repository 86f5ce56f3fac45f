"""Average-link merging of topics against a brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from patronvoice.operators import agglomerate
from patronvoice.operators.agglomerate import merge_by_average_link


def brute(vectors, count=None, tau=0.0):
    """Merges the best pair again and again; the similarities of the merges and the groups at the end."""
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    groups, steps = {i: [i] for i in unit}, []
    while len(groups) > (count or 1):
        best = min(
            (-np.mean([unit[x] @ unit[y] for x in groups[a] for y in groups[b]]), a, b) for a in groups for b in groups if a < b
        )
        if -best[0] < tau or best[0] == 0:
            break
        steps.append(-best[0])
        groups[best[1]] = groups[best[1]] + groups.pop(best[2])
    return steps, {i: a for a, members in groups.items() for i in members}


def planted(seed=0, groups=4, per=6, terms=30):
    rng = np.random.default_rng(seed)
    centres = rng.random((groups, terms)) * (rng.random((groups, terms)) < 0.4)
    centres[:, 0] = 0.1
    vectors = {7 * (g * per + k) + 3: centres[g] + 0.25 * rng.random(terms) * (rng.random(terms) < 0.5) for g in range(groups) for k in range(per)}
    rows = [(i, f"t{j}", float(x)) for i, v in vectors.items() for j, x in enumerate(v) if x]
    return vectors, rows


def merged(spark, rows, **how):
    df = spark.createDataFrame(rows, "topic_id bigint, term string, weight double").repartition(3)
    return {r["topic_id"]: r["merged"] for r in merge_by_average_link(df, "topic_id", **how).collect()}


@pytest.mark.parametrize("block", [512, 5])
def test_equals_merging_the_best_pair(spark, monkeypatch, block):
    monkeypatch.setattr(agglomerate, "_TOPICS", block)
    monkeypatch.setattr(agglomerate, "_CELLS", 100 if block == 5 else 1 << 22)
    vectors, rows = planted()
    assert merged(spark, rows, count=7) == brute(vectors, count=7)[1]
    assert merged(spark, rows, tau=0.6) == brute(vectors, tau=0.6)[1]


def test_stops_at_the_widest_gap(spark):
    vectors, rows = planted(seed=3)
    steps, _ = brute(vectors)
    cut = int(np.argmax(-np.diff(steps))) + 1
    assert merged(spark, rows) == brute(vectors, count=len(vectors) - cut)[1]
    assert len(vectors) - cut == 4  # the planted groups


def test_does_not_chain(spark):
    """Single link joins a row of topics, each like the next one; average link does not."""
    angles = np.arange(8) * 0.2
    rows = [(i, t, float(f(x))) for i, x in enumerate(angles) for t, f in (("x", np.cos), ("y", np.sin))]
    got = merged(spark, rows, tau=0.95)
    assert 1 < len(set(got.values())) < 8


def test_odd_tables(spark):
    rows = [(1, "a", 1.0), (2, "a", 0.5), (2, "a", 0.5), (3, "b", 2.0), (4, None, 1.0), (5, "a", 0.0), (6, "b", None), (-1, "a", 1.0), (None, "a", 1.0)]
    assert merged(spark, rows, count=1) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert merged(spark, [], count=1) == {} and merged(spark, []) == {}
    assert merged(spark, [(1, "a", 1.0), (2, "a", 3.0), (3, "a", 2.0)], tau=0.9) == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        merged(spark, rows, count=1, tau=0.5)


def test_a_task_holds_little_whatever_the_vocabulary():
    """A group of rows is as large as ``_CELLS`` says; with its terms as Python strings it must be a small part of an executor."""
    n = agglomerate._CELLS
    tracemalloc.start()
    frame = pd.DataFrame({"node": np.arange(n) % 80, "term": [f"term number {i // 80}" for i in range(n)], "unit": 0.1, "side": np.arange(n) // 2 % 2, "p": 0, "q": 0, "chunk": 0})
    agglomerate._blocks_to_dots(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
