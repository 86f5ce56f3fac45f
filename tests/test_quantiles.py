import numpy as np
import pytest
from patronvoice.operators.quantiles import (
    global_median,
    group_median,
    impute_group_median,
    quantiles,
    quartiles_iqr,
    values_long,
    weighted_quantiles,
    winsorize_iqr,
)
from pyspark.sql import functions as F


def _frame(spark, values, groups=None, parts=3):
    rows = [(float(v) if v is not None else None, g) for v, g in zip(values, groups or ["g"] * len(values))]
    return spark.createDataFrame(rows, "v double, g string").repartition(parts)


@pytest.mark.parametrize(
    "values",
    [
        [1, 2, 3, 10],
        [5],
        [0, 0, 0, 0],
        [-5, -1e-9, 0, 1e-300, 3, 1e300],
        list(np.random.default_rng(1).lognormal(0, 3, 500)),
        list(-np.random.default_rng(2).normal(0, 1, 400)),
        [7] * 300 + [8] + list(range(50)),
        [2.0**k for k in range(-20, 20)] + [np.nextafter(2.0**k, 0) for k in range(-20, 20)],
    ],
)
def test_matches_linear_interpolation(spark, values):
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in quantiles(_frame(spark, values), ["v"], probs).collect()}
    assert got == pytest.approx({p: float(np.quantile(values, p)) for p in probs}, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_groups_skew_and_nulls(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr("patronvoice.operators.quantiles.BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(3)
    groups = ["hot"] * 2000 + [f"g{i % 50}" for i in range(1000)] + [None] * 10
    values = [None if i % 17 == 0 else float(x) for i, x in enumerate(rng.gamma(2, 100, len(groups)))]
    got = {r["g"]: r["median"] for r in group_median(_frame(spark, values, groups, 7), "v", "g").collect()}
    want = {}
    for g in set(groups) - {None}:
        want[g] = float(np.median([v for v, h in zip(values, groups) if h == g and v is not None]))
    assert got == pytest.approx(want)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_crowded_parts_are_split_again(spark, monkeypatch, groups):
    monkeypatch.setattr("patronvoice.operators.quantiles.OPEN_ROWS", 5)
    rng = np.random.default_rng(9)
    # nearly all values share one part of the histogram; some are copies
    values = list(1e6 + rng.random(700) * 1e-3) + [1e6 + 2e-3] * 90 + [-4.0, 0.0, 3e7]
    got = quantiles(_frame(spark, values), ["v"], [0.1, 0.5, 0.9, 0.97], groups)
    want = {p: float(np.quantile(values, p)) for p in (0.1, 0.5, 0.9, 0.97)}
    assert {r["prob"]: r["quantile"] for r in got.collect()} == pytest.approx(want, rel=1e-15)


def test_empty_column(spark):
    assert global_median(_frame(spark, [None, None]), "v").first()["median"] is None


def test_approximate_is_close(spark):
    df = _frame(spark, range(1001))
    assert abs(global_median(df, "v", approx=True).first()["median"] - 500) <= 1


def test_winsorize(spark):
    values = [None, -100, 1, 2, 3, 4, 5, 6, 7, 1000]
    known = [v for v in values if v is not None]
    q1, q3 = np.quantile(known, [0.25, 0.75])
    lo, hi = max(0, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)
    got = winsorize_iqr(_frame(spark, values), ["v", "absent"], floors={"v": 0}, integral=False)
    rows = sorted(((r["v"], r["v_outlier"]) for r in got.collect()), key=str)
    want = [(None if v is None else float(min(max(v, lo), hi)), int(v is not None and (v < lo or v > hi))) for v in values]
    assert rows == sorted(want, key=str)
    bounds = quartiles_iqr(_frame(spark, values), ["v"], floors={"v": 0}).first()
    assert (bounds["lower"], bounds["upper"]) == (lo, hi)


@pytest.mark.parametrize("approx", [False, True])
def test_impute_falls_back_after_the_group_fill(spark, approx):
    rows = [("a", 10.0), ("a", 30.0), ("a", None), ("b", 100.0), ("b", None), ("b", None), ("none", None), (None, None), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = impute_group_median(df, "v", "g", approx)
    # after the group fill the column is 10 30 20 100 100 100 7: its median serves the rest
    filled = [10, 30, 10 if approx else 20, 100, 100, 100, 7]
    overall = float(np.quantile(filled, 0.5, method="inverted_cdf" if approx else "linear"))
    want = [("a", 10.0), ("a", 30.0), ("a", float(filled[2])), ("b", 100.0), ("b", 100.0), ("b", 100.0), ("none", overall), (None, overall), (None, 7.0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_partitioning_does_not_matter(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("v"), F.lit("g").alias("g"))
    got = {n: quantiles(df.repartition(n), ["v"], [0.1, 0.5], ["g"]).orderBy("prob").collect() for n in (1, 8)}
    assert got[1] == got[8]


def test_infinities_and_nan(spark):
    inf = float("inf")
    rows = [("a", v) for v in (-inf, 1.0, 2.0, inf, inf, float("nan"), None)] + [("b", inf), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["quantile"] for r in weighted_quantiles(values_long(df, ["g"], ["v"]), ["g"], [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): -inf, ("a", 0.5): 2.0, ("a", 1.0): inf, ("b", 0.0): inf, ("b", 0.5): inf, ("b", 1.0): inf}
    filled = {r["v"] for r in impute_group_median(df.where("g = 'b'"), "v", "g").collect()}
    assert filled == {inf}
