"""Raw listings to the clean entity table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.operators import cleaning as ops
from patronvoice.operators.joins import compact_keys
from patronvoice.operators.quality import audit_record, audit_rows, cleaning_report, union_audits, validate
from patronvoice.operators.quantiles import (
    fit_group_medians,
    impute_group_median,
    quartiles_of_counts,
    values_long,
    winsorize_iqr,
)
from patronvoice.session import materialize
from patronvoice.sources.readers import read_raw_listings
from patronvoice.sources.writers import write_table


@dataclass(frozen=True)
class CleanParams:
    key: str = "url"
    identity: tuple[str, ...] = ("name",)
    cost: str = "approx_cost"
    cost_group: str = "rest_type"
    caps: dict[str, float] = field(default_factory=lambda: {"votes": 0, "approx_cost": 50})
    iqr_k: float = 1.5
    review_form: str = "literal"
    approx: bool = False


def clean_rows(df: DataFrame) -> DataFrame:
    """The steps that look at one row only, up to the parsed numbers."""
    return (
        df.transform(ops.missing_flag, "rate")
        .transform(ops.fill_missing)
        .transform(ops.parse_numbers)
    )


def finish(parsed: DataFrame, p: CleanParams) -> DataFrame:
    """From parsed numbers to features; the order of the steps changes results.

    Costs are grouped by the type as typed, before title-casing; the tier uses
    the uncapped cost; popularity uses the capped votes. All statistics come
    from counts of single columns of ``parsed``, so the full rows are read once.
    """
    group, df, counts = p.cost_group, parsed, []
    if p.cost in parsed.columns:
        if group not in parsed.columns:
            group = "_all"
            df = df.withColumn(group, F.lit("all"))
        if p.approx:
            df = impute_group_median(df, p.cost, group, approx=True)
        else:
            fitted = fit_group_medians(df, p.cost, group)
            df = impute_group_median(df, p.cost, group, fitted=fitted)
            counts.append(fitted.filled.withColumn("value", F.rint("value")))
        df = df.drop("_all").transform(ops.round_cost_and_tier)
    capped = [c for c in p.caps if c in df.columns]
    if p.approx:
        df = winsorize_iqr(df, capped, p.iqr_k, p.caps, approx=True)
    elif capped:
        rest = [c for c in capped if c != p.cost]
        if rest:
            counts.append(values_long(parsed, [], rest))
        found = quartiles_of_counts(reduce(DataFrame.unionByName, counts), p.iqr_k, p.caps)
        # one row per capped column
        bounds = {r["metric"]: (r["lower"], r["upper"]) for r in found.collect()}
        df = winsorize_iqr(df, capped, bounds=bounds)
    return (
        df.transform(ops.encode_binary_columns)
        .transform(ops.clean_text_columns)
        .transform(ops.parse_reviews_column, form=p.review_form)
        .transform(ops.derived_features)
    )


def deduplicate(raw: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """Tidy names, one row per key.

    Copies of a whole row share their key, so the key de-duplication removes
    them too and no separate pass over all columns is needed.
    """
    named = ops.normalize_column_names(raw)
    if params.key not in named.columns:
        return ops.drop_exact_duplicates(named)
    return ops.keep_most_complete(named, params.key)


def clean_listings(raw: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """The whole cleaning job.

    The de-duplicated and parsed rows are written once; medians and bounds are
    then counted on their own columns instead of repeating the shuffle.
    """
    parsed = deduplicate(raw, params).transform(ops.drop_null_identity, params.identity).transform(clean_rows)
    return finish(materialize(parsed), params)


def cleaning_audit(raw: DataFrame, cleaned: DataFrame, params: CleanParams = CleanParams()) -> DataFrame:
    """One row per cleaning decision.

    Counted from the tables themselves, three passes in all, and not with
    counters carried along by the job: those count a row again when a lost task
    is repeated.
    """
    named = ops.normalize_column_names(raw)
    have = set(named.columns)
    parts = [
        audit_rows(
            named,
            [
                audit_record("load", "all", "raw load", F.count(F.lit(1)), f"{len(raw.columns)} columns"),
                audit_record("column_names", "all", "renamed and normalised", F.lit(0), ",".join(named.columns)),
            ],
        )
    ]
    # each row once, with its number of copies; then each key once
    copies = compact_keys(named, named.columns).groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_n"))
    if params.key in have:
        per_key = copies.groupBy(params.key).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    else:
        per_key = copies.withColumn("_d", F.lit(1))
    total, kinds, kept = F.sum("_n"), F.sum("_d"), F.count(F.lit(1))
    parts.append(
        audit_rows(
            per_key,
            [
                audit_record("duplicates", "all_columns", "dropped exact duplicates", total - kinds),
                audit_record("duplicates", params.key, "dropped duplicates, kept most complete row", kinds - kept),
                audit_record("duplicates", "all", "total rows removed", total - kept),
            ],
        )
    )
    unique = deduplicate(raw, params)
    identified = F.lit(True)
    records = []
    for c in params.identity:
        if c in have:
            gone = identified & F.col(c).isNull()
            records.append(audit_record("missing", c, "dropped rows with null identity column", F.count_if(gone)))
            identified = identified & F.col(c).isNotNull()
    if "rate" in have:
        records.append(audit_record("missing", "rate", "flagged missing", F.count_if(identified & F.col("rate").isNull())))
    for c, value in ops.FILL_CONSTANTS.items():
        if c in have:
            filled = F.count_if(identified & F.col(c).isNull())
            records.append(audit_record("missing", c, f"filled with '{value}'", filled))
    if records:
        parts.append(audit_rows(unique, records))
    parsed = unique.transform(ops.drop_null_identity, params.identity).transform(clean_rows)
    present = F.count(F.lit(1))
    records = []
    for c in ("rate", "votes"):
        if c in have:
            records.append(audit_record("parse", c, "parsed to number", F.count(c), F.format_string("%d without value", present - F.count(c))))
    if params.cost in have:
        records.append(audit_record("impute", params.cost, "filled with group median", F.count_if(F.col(params.cost).isNull())))
    if records:
        parts.append(audit_rows(parsed, records))
    got = set(cleaned.columns)
    n = F.count(F.lit(1))
    records = []
    if "cost_tier" in got:
        records.append(audit_record("feature", "cost_tier", "binned cost", n))
    for c in ("online_order", "book_table"):
        if f"{c}_enc" in got:
            records.append(audit_record("encode", c, "Yes/No to 1/0", F.sum(f"{c}_enc")))
    for c in (*ops.TITLE_COLUMNS, "cuisines", "address"):
        if c in got:
            records.append(audit_record("text", c, "cleaned text", n))
    if "review_count" in got:
        records.append(audit_record("parse", "reviews_list", "parsed to array", F.count_if(F.col("review_count") > 0), F.format_string("%d texts", F.coalesce(F.sum("review_count"), F.lit(0)))))
    for c in params.caps:
        if f"{c}_outlier" in got:
            records.append(audit_record("outliers", c, "capped to IQR bounds", F.sum(f"{c}_outlier")))
    for c, action in (("rating_tier", "binned rate"), ("primary_cuisine", "first cuisine"), ("popularity_score", "log1p(votes)")):
        if c in got:
            records.append(audit_record("feature", c, action, n))
    if "has_reviews" in got:
        records.append(audit_record("feature", "has_reviews", "flagged entities with a review", F.sum("has_reviews")))
    parts.append(audit_rows(cleaned, records))
    return union_audits(parts)


def run_cleaning(
    spark: SparkSession, path: str, out_dir: str, params: CleanParams = CleanParams(), min_rows: int = 1000
) -> DataFrame:
    """Read, clean, write, then audit and validate what was written."""
    raw = read_raw_listings(spark, path)
    write_table(clean_listings(raw, params), f"{out_dir}/cleaned")
    cleaned = spark.read.parquet(f"{out_dir}/cleaned")
    validate(cleaned, params.key, min_rows=min_rows, raise_=True)
    report = cleaning_report(cleaned, cleaning_audit(raw, cleaned, params))
    write_table(report, f"{out_dir}/cleaning_report", "json")
    return cleaned
