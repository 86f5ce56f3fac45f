"""Exact quantiles without gathering a group in one task.

Spark's ``percentile`` and ``median`` keep every distinct value of a group in the
memory of one task. Here a log-linear histogram is counted first: its parts are a
fixed function of the value (binary exponent, then equal steps up to the next
power of two), so rows combine before the shuffle and no range has to be known.
The counts tell which parts hold the wanted ranks; only the values of those
parts, a sliver of the data, are counted and ordered; a part that is still too
large is split again. Ranks are counted, never estimated: the result is exact and
independent of the partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronvoice.operators.joins import lookup_join, scalar
from patronvoice.session import materialize

STEPS = 4096  # equal parts between two powers of two
OPEN_ROWS = 20_000_000  # a part with more rows is split again before it is ordered
BROADCAST_ROWS = 100_000


def histogram_part(value: Column) -> Column:
    """Number of the part a value falls into; grows with the value.

    An exponent that is off by one next to a power of two is evened out by the
    second term, so the numbering stays monotone.
    """
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    part = (exponent + 1100) * STEPS + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    ends = 3000 * STEPS  # infinities lie beyond every other part
    part = F.when(size == float("inf"), F.lit(ends).cast("bigint")).otherwise(part)
    # smaller magnitudes than 2^-1000 share part 0 with zero
    return F.when(size < 2.0**-1000, F.lit(0).cast("bigint")).when(value > 0, part).otherwise(-part)


def values_long(df: DataFrame, groups: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(groups, metric, value, n=1): one row per non-null value of each column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*groups, F.inline(pairs))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("n", F.lit(1).cast("bigint"))
    )


def weighted_quantiles(counts: DataFrame, groups: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles of a (groups, metric, value, n) table.

    Returns (groups, metric, prob, quantile) with linear interpolation between
    the two neighbouring values. The parts holding the wanted ranks are found at
    once and written; reading the values in them is left to the caller's query.
    """
    keys = [*groups, "metric"]
    counts = counts.withColumn("part", histogram_part(F.col("value")))
    picked = materialize(_first_parts(counts, keys, probs))
    while True:
        size = picked.agg(
            F.count(F.lit(1)).alias("parts"), F.max(F.when(F.col("lo") < F.col("hi"), F.col("in_part"))).alias("largest")
        ).first()
        if (size["largest"] or 0) <= OPEN_ROWS:
            break
        picked = materialize(_split_parts(_open(counts, picked, keys, size["parts"]), keys))
    sliver = (
        _open(counts, picked, keys, size["parts"])
        .groupBy(*keys, "lo", "value")
        .agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("total", "before", "ranks")])
    )
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "lo").orderBy("value"))
    mine = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    at_rank = (
        sliver.withColumn("upto", upto)
        .select(*keys, "total", "value", F.explode(mine).alias("rank"))
        .groupBy(*keys)
        .agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    )
    position = F.col("prob") * (F.col("total") - 1)
    below, above = F.col("at")[F.floor(position)], F.col("at")[F.ceil(position)]
    share = position - F.floor(position)
    return at_rank.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")).select(
        *keys, "prob", F.when(below == above, below).otherwise(below + (above - below) * share).alias("quantile")
    )


def _first_parts(counts: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """The histogram parts that hold a wanted rank; the windows see one row per part."""
    histogram = counts.groupBy(*keys, "part").agg(
        F.sum("n").alias("in_part"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    by_key = Window.partitionBy(*keys)
    ranks = [f(F.lit(float(p)) * (F.col("total") - 1)) for p in probs for f in (F.floor, F.ceil)]
    return _holding(
        histogram.withColumns(
            {"upto": F.sum("in_part").over(by_key.orderBy("part")), "total": F.sum("in_part").over(by_key)}
        ).withColumns({"before": F.lit(0).cast("bigint"), "ranks": F.array_distinct(F.array(*ranks))}),
        keys,
    )


def _split_parts(opened: DataFrame, keys: list[str]) -> DataFrame:
    """Equal sub-parts of parts that hold too many rows for one task."""
    span = F.col("hi") - F.col("lo")
    sub = F.when(span > 0, F.least(F.floor((F.col("value") - F.col("lo")) / span * STEPS), F.lit(STEPS - 1))).otherwise(0)
    known = ["part", "total", "before", "ranks"]
    counted = opened.groupBy(*keys, *known, F.col("lo").alias("from"), sub.alias("sub")).agg(
        F.sum("n").alias("in_part"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    w = Window.partitionBy(*keys, "from").orderBy("sub")
    return _holding(counted.withColumn("upto", F.sum("in_part").over(w)), keys)


def _holding(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts with a wanted rank among their rows, and how many rows come before them."""
    hit = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("in_part")))
    return (
        parts.withColumn("start", F.col("before") + F.col("upto") - F.col("in_part"))
        .withColumn("held", hit)
        .where(F.size("held") > 0)
        .select(*keys, "part", "lo", "hi", "in_part", "total", F.col("start").alias("before"), F.col("held").alias("ranks"))
    )


def _open(counts: DataFrame, picked: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """The values inside the picked parts. A few parts, counted before, need no shuffle of the values."""
    if parts <= BROADCAST_ROWS:
        joined = counts.join(F.broadcast(picked), [*keys, "part"])
    else:
        folded = counts.groupBy(*keys, "part", "value").agg(F.sum("n").alias("n"))
        joined = folded.join(picked, [*keys, "part"])
    return joined.where(F.col("value").between(F.col("lo"), F.col("hi")))


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    groups: Sequence[str] = (),
    approx: bool = False,
    accuracy: int = 10_000,
) -> DataFrame:
    """(groups, metric, prob, quantile) for several columns and probabilities at once.

    Rows with a null group are left out. ``approx`` takes one pass with
    ``percentile_approx`` instead.
    """
    for group in groups:
        df = df.where(F.col(group).isNotNull())
    if not approx:
        return weighted_quantiles(values_long(df, groups, cols), groups, probs)
    grid = F.array(*[F.lit(float(p)) for p in probs])
    aggs = [
        F.percentile_approx(F.col(c).cast("double"), list(map(float, probs)), accuracy).alias(c) for c in cols
    ]
    return (
        df.groupBy(*groups)
        .agg(*aggs)
        .select(
            *groups,
            F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.arrays_zip(grid.alias("prob"), F.col(c).alias("quantile")).alias("q")) for c in cols])),
        )
        .select(*groups, "metric", F.inline("q"))
        .toDF(*groups, "metric", "prob", "quantile")
    )


def group_median(df: DataFrame, value: str, group: str, approx: bool = False) -> DataFrame:
    """(group, median) over the non-null values of each group."""
    return quantiles(df, [value], [0.5], [group], approx).select(group, F.col("quantile").alias("median"))


def global_median(df: DataFrame, value: str, approx: bool = False) -> DataFrame:
    """One row with the median over the column; null when there is no value."""
    return quantiles(df, [value], [0.5], approx=approx).agg(F.max("quantile").alias("median"))


def quartiles_iqr(
    df: DataFrame,
    cols: Sequence[str],
    k: float = 1.5,
    floors: Mapping[str, float] | None = None,
    approx: bool = False,
) -> DataFrame:
    """One row per column: q1, q3, iqr and the lower (not under its floor) and upper bound."""
    return _bounds(quantiles(df, cols, [0.25, 0.75], approx=approx), k, floors or {})


def quartiles_of_counts(counts: DataFrame, k: float = 1.5, floors: Mapping[str, float] | None = None) -> DataFrame:
    """The same from a (metric, value, n) table."""
    return _bounds(weighted_quantiles(counts, [], [0.25, 0.75]), k, floors or {})


def _bounds(found: DataFrame, k: float, floors: Mapping[str, float]) -> DataFrame:
    q = found.groupBy("metric").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"),
    )
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    fence = F.col("q1") - k * F.col("iqr")
    lower = fence
    for col, floor in floors.items():
        lower = F.when(F.col("metric") == col, F.greatest(F.lit(float(floor)), fence)).otherwise(lower)
    return q.withColumns({"lower": lower, "upper": F.col("q3") + k * F.col("iqr")})


@dataclass(frozen=True)
class GroupMedians:
    """What filling a column needs, small next to the rows it was counted from."""

    by_group: DataFrame  # (group, median)
    overall: Column  # median of the group-filled column
    filled: DataFrame  # (metric, value, n) of the column once filled


def fit_group_medians(df: DataFrame, value: str, group: str) -> GroupMedians:
    """Count (group, value) once and derive every statistic from the counts."""
    counted = materialize(
        df.groupBy(group, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    )
    number = F.col("value").isNotNull() & ~F.isnan("value")
    known = counted.where(number & F.col(group).isNotNull()).withColumn("metric", F.lit(value))
    medians = materialize(
        weighted_quantiles(known, [group], [0.5]).select(group, F.col("quantile").alias("median"))
    )
    group_filled = materialize(
        lookup_join(counted, medians, [group], salts=16)
        .groupBy(F.lit(value).alias("metric"), F.coalesce("value", "median").alias("value"))
        .agg(F.sum("n").alias("n"))
    )
    with_value = group_filled.where(number)
    # one number
    overall = F.lit(weighted_quantiles(with_value, [], [0.5]).agg(F.max("quantile")).first()[0]).cast("double")
    filled = group_filled.withColumn("value", F.coalesce("value", overall)).where(F.col("value").isNotNull())
    return GroupMedians(medians, overall, filled)


def impute_group_median(
    df: DataFrame, value: str, group: str, approx: bool = False, fitted: GroupMedians | None = None
) -> DataFrame:
    """Fill nulls with the group's median, then with the median of the filled column."""
    typed = df.withColumn(value, F.col(value).cast("double"))
    if approx:
        filled = lookup_join(typed, group_median(typed, value, group, True), [group], salts=16).withColumn(
            value, F.coalesce(value, "median")
        )
        overall = global_median(filled, value, True).scalar()
        return filled.withColumn(value, F.coalesce(F.col(value), overall)).select(*df.columns)
    fitted = fitted or fit_group_medians(df, value, group)
    return (
        lookup_join(typed, fitted.by_group, [group], salts=16)
        .withColumn(value, F.coalesce(F.col(value), F.col("median"), fitted.overall))
        .select(*df.columns)
    )


def winsorize_iqr(
    df: DataFrame,
    cols: Sequence[str],
    k: float = 1.5,
    floors: Mapping[str, float] | None = None,
    integral: bool = True,
    approx: bool = False,
    bounds: Mapping[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Clip to the IQR bounds and flag what was clipped; nulls stay null with flag 0.

    ``bounds`` gives (lower, upper) per column when they are known already.
    """
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    if bounds is None:
        found = quartiles_iqr(df, cols, k, floors, approx)
        row = scalar(
            found.agg(*[F.max(F.when(F.col("metric") == c, F.struct("lower", "upper"))).alias(c) for c in cols])
        )
        limits = {c: (row[c]["lower"], row[c]["upper"]) for c in cols}
    else:
        limits = {c: (F.lit(lo).cast("double"), F.lit(hi).cast("double")) for c, (lo, hi) in bounds.items()}
    flags, clipped = {}, {}
    for c in cols:
        x, (lo, hi) = F.col(c).cast("double"), limits.get(c, (F.lit(None).cast("double"),) * 2)
        flags[f"{c}_outlier"] = F.coalesce((x < lo) | (x > hi), F.lit(False)).cast("int")
        clip = F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))
        clipped[c] = F.rint(clip).cast("bigint") if integral else clip
    return df.withColumns(flags).withColumns(clipped)
