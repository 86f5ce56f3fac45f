"""Audit trail, validation and profiles. Every result is a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.operators.joins import compact


def audit_record(step: str, column: str, action: str, rows: Column, detail: Column | str = "") -> Column:
    """One audit row as a struct; ``rows`` is an aggregate over the step's table."""
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(
        F.lit(step).alias("step"),
        F.lit(column).alias("column"),
        F.lit(action).alias("action"),
        F.coalesce(rows, F.lit(0)).cast("bigint").alias("rows_affected"),
        detail.alias("detail"),
    )


def audit_rows(df: DataFrame, records: Sequence[Column]) -> DataFrame:
    """All records of one table in a single pass over it."""
    return df.agg(F.array(*records).alias("records")).select(F.inline("records"))


def null_summary(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)]
    return counted.select(F.inline(F.array(*pairs)))


def _text_form(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return compact(F.to_json(c) if nested else c.cast("string"))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, dtype, null_pct, distinct_values) per column.

    The exact distinct count compares whole values, long ones by their SHA-256:
    each (column, value) pair is folded before and after the shuffle, so no task
    holds a column's value set.
    ``approx`` needs one pass and a fixed-size sketch per column.
    """
    fields = df.schema.fields
    null_pct = [(F.avg(F.col(f"`{f.name}`").isNull().cast("int")) * 100).alias(f"p{i}") for i, f in enumerate(fields)]
    if approx:
        distinct = [F.approx_count_distinct(_text_form(f)).alias(f"d{i}") for i, f in enumerate(fields)]
        one = df.agg(*null_pct, *distinct)
        rows = [
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.col(f"p{i}").alias("null_pct"),
                F.col(f"d{i}").alias("distinct_values"),
            )
            for i, f in enumerate(fields)
        ]
        return one.select(F.inline(F.array(*rows)))
    pairs = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), _text_form(f).alias("value")) for i, f in enumerate(fields)]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("i", "column", "dtype", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column", "dtype")
        .agg(
            (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("null_pct"),
            F.count("value").alias("distinct_values"),
        )
    )


def validate(
    df: DataFrame,
    key: str = "url",
    rate: str = "rate",
    votes: str = "votes",
    min_rows: int = 1000,
    raise_: bool = False,
    rate_range: tuple[float, float] = (1.0, 5.0),
) -> DataFrame:
    """(check, column, violations, status) for each invariant whose column exists.

    With ``raise_`` the checks run at once and a failed one raises ``ValueError``.
    """
    row_checks = {}
    if rate in df.columns:
        row_checks["in_range", rate] = ~F.col(rate).between(*rate_range)
    if votes in df.columns:
        row_checks["non_negative", votes] = F.col(votes) < 0

    def row(check: str, column: str, violations: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), F.lit(column).alias("column"), violations.cast("bigint").alias("violations"))

    missing = F.greatest(F.lit(min_rows) - F.count(F.lit(1)), F.lit(0))
    rows = [row(check, c, F.count_if(bad)) for (check, c), bad in row_checks.items()]
    result = df.agg(F.array(*rows, row("min_rows", "all", missing)).alias("rows")).select(F.inline("rows"))
    if key in df.columns:
        repeats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        unique = repeats.agg(F.array(row("unique", key, F.coalesce(F.sum(F.col("n") - 1), F.lit(0)))).alias("rows"))
        result = result.unionByName(unique.select(F.inline("rows")))
    result = result.withColumn("status", F.when(F.col("violations") == 0, "PASS").otherwise("FAIL"))
    if raise_:
        failed = result.where("violations > 0").collect()  # one row per check
        if failed:
            raise ValueError("; ".join(f"{r['column']}: {r['violations']} violations of {r['check']}" for r in failed))
    return result


def cleaning_report(df: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """One row: shape, column list, null count per column, audit steps."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    nulls = [x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col(f"n{i}"))]
    report = counted.select(
        F.struct("rows", F.lit(len(df.columns)).alias("columns")).alias("final_shape"),
        F.array(*[F.lit(c) for c in df.columns]).alias("final_columns"),
        F.create_map(*nulls).alias("null_summary"),
    )
    if audit is None:
        return report
    # the audit has a fixed number of rows per cleaning step
    steps = audit.agg(F.collect_list(F.struct(*audit.columns))).scalar()
    return report.withColumn("cleaning_steps", steps)


def cleaning_summary(df: DataFrame, count_col: str = "review_count", approx: bool = False) -> DataFrame:
    """Column profile plus the number of extracted reviews on every row."""
    profile = column_profile(df, approx)
    if count_col not in df.columns:
        return profile
    return profile.withColumn("reviews_extracted", df.agg(F.sum(count_col)).scalar())


def union_audits(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
