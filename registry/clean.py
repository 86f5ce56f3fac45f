"""Cleaning queries on messy listings derived from ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronvoice import functions as fn
from patronvoice.operators import cleaning as ops
from patronvoice.operators import quality
from patronvoice.operators.quantiles import (
    global_median,
    group_median,
    impute_group_median,
    quartiles_iqr,
    winsorize_iqr,
)
from patronvoice.operators.sentiment import explode_reviews, non_blank_text
from patronvoice.plans.clean import clean_listings, cleaning_audit
from registry.base import BS, CTES, HAS_TEXTS, NL, RAW, TEXT_1, TEXT_2, r6, register, rnd
from patronvoice.operators.breakdowns import value_counts

COST = "approx_cost(for two people)"
_SHORT = {c: ops.RENAMES.get(c, c) for c in RAW}
_ORDER = sorted(v for v in _SHORT.values() if v != "url")

CTES["named"] = (("raw",), "SELECT " + ", ".join(f'"{c}" AS {n}' for c, n in _SHORT.items()) + " FROM raw")
_NULLS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _SHORT.values())
CTES["uniq"] = (
    ("named",),
    f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_NULLS}, "
    + ", ".join(f"{c} NULLS FIRST" for c in _ORDER)
    + ") AS rn FROM named) WHERE rn = 1",
)


def _title(expr: str) -> str:
    spaced = f"regexp_replace(trim({expr}), '\\s+', ' ', 'g')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({spaced}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda w: concat(upper(w[1]), lower(w[2:]))), '')"
    )


_RATE_X = "TRY_CAST(regexp_extract(rate, '([0-9]+\\.?[0-9]*)', 1) AS DOUBLE)"
_RATE = rnd(f"CASE WHEN {_RATE_X} BETWEEN 1 AND 5 THEN {_RATE_X} END", 1)
_VOTES_X = "TRY_CAST(replace(votes, ',', '') AS DOUBLE)"
_VOTES = f"CAST(CASE WHEN {_VOTES_X} >= 0 THEN {_VOTES_X} END AS BIGINT)"
_COST_X = "TRY_CAST(regexp_replace(approx_cost, '[,₹\\s]', '', 'g') AS DOUBLE)"
_COST = f"CASE WHEN {_COST_X} > 0 THEN {_COST_X} END"
_YES = "CASE WHEN lower(trim({0})) = 'yes' THEN 1 ELSE 0 END"


def _tier(c: str) -> str:
    return (
        f"CASE WHEN {c} <= 0 THEN NULL WHEN {c} <= 300 THEN 'budget' WHEN {c} <= 600 THEN 'low-mid' WHEN {c} <= 1000 THEN 'mid' "
        f"WHEN {c} <= 2000 THEN 'premium' WHEN {c} IS NOT NULL THEN 'luxury' END"
    )


@register("normalize_column_names", "SELECT * FROM named", "named")
def _(t):
    return ops.normalize_column_names(t.raw)


@register("normalize_nulls", "SELECT rate, votes, nullif(CASE WHEN votes = 'abc' THEN NULL ELSE votes END, '-3') AS votes_kept FROM named", "named")
def _(t):
    from patronvoice.sources.readers import normalize_nulls

    df = t.raw.select("rate", "votes", F.col("votes").alias("votes_kept"))
    kept = normalize_nulls(df.select("votes_kept", F.struct("rate", "votes").alias("s")), ["abc", "-3"])
    return kept.select("s.rate", "s.votes", "votes_kept")


@register("drop_exact_duplicates", "SELECT DISTINCT lang, text FROM documents")
def _(t):
    return ops.drop_exact_duplicates(t.documents.select("lang", "text"))


@register("distinct_dup_count", "SELECT count(*) - count(DISTINCT text) AS duplicates FROM documents")
def _(t):
    return ops.distinct_dup_count(t.documents, ["text"])


@register("keep_most_complete", "SELECT * FROM uniq", "uniq")
def _(t):
    return ops.keep_most_complete(ops.normalize_column_names(t.raw), "url")


@register(
    "dedup_by_key",
    "SELECT * EXCLUDE (rn) FROM (SELECT doc_id, lang, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
)
def _(t):
    return ops.dedup_by_key(t.documents.select("doc_id", "lang", "source", "text"), "text")


@register("drop_null_identity", "SELECT * FROM named WHERE name IS NOT NULL", "named")
def _(t):
    return ops.drop_null_identity(ops.normalize_column_names(t.raw))


@register("missing_flag", "SELECT url, rate, CASE WHEN rate IS NULL THEN 1 ELSE 0 END AS rate_missing FROM raw", "raw")
def _(t):
    return ops.missing_flag(t.raw.select("url", "rate"), "rate")


_FILLED = ", ".join(
    f"coalesce({c}, '{ops.FILL_CONSTANTS[c]}') AS {c}" if c in ops.FILL_CONSTANTS else c for c in _SHORT.values()
)


@register("fill_missing", f"SELECT {_FILLED} FROM named", "named")
def _(t):
    return ops.fill_missing(ops.normalize_column_names(t.raw))


@register("null_summary", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM named" for c in _SHORT.values()) + ")", "named")
def _(t):
    return quality.null_summary(ops.normalize_column_names(t.raw))


@register("parse_rating", f"SELECT url, rate AS raw_rate, {_RATE} AS rate FROM named", "named")
def _(t):
    return t.raw.select("url", F.col("rate").alias("raw_rate"), fn.parse_rating(F.col("rate")).alias("rate"))


@register("range_to_null", "SELECT event_id, CASE WHEN value BETWEEN 5 AND 50 THEN value END AS value FROM events")
def _(t):
    return t.read("events").select("event_id", fn.range_to_null(F.col("value"), 5, 50).alias("value"))


@register("parse_count", f"SELECT url, votes AS raw_votes, {_VOTES} AS votes FROM named", "named")
def _(t):
    return t.raw.select("url", F.col("votes").alias("raw_votes"), fn.parse_count(F.col("votes")).alias("votes"))


@register("parse_money", f"SELECT url, approx_cost AS raw_cost, {_COST} AS approx_cost FROM named", "named")
def _(t):
    return t.raw.select("url", F.col(COST).alias("raw_cost"), fn.parse_money(F.col(COST)).alias("approx_cost"))


@register("coerce_numeric", "SELECT votes, TRY_CAST(votes AS DOUBLE) AS number FROM named", "named")
def _(t):
    return t.raw.select("votes", fn.coerce_numeric(F.col("votes")).alias("number"))


@register("negative_to_null", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS kept, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS positive FROM customer")
def _(t):
    c = F.col("c_acctbal")
    return t.read("customer").select("c_custkey", fn.negative_to_null(c).alias("kept"), fn.negative_to_null(c, inclusive=True).alias("positive"))


@register("encode_yes_no", f"SELECT url, {_YES.format('online_order')} AS online_order_enc, {_YES.format('book_table')} AS book_table_enc FROM raw", "raw")
def _(t):
    return ops.encode_binary_columns(t.raw.select("url", "online_order", "book_table")).drop("online_order", "book_table")


@register("title_case_clean", f"SELECT url, {_title('name')} AS name, {_title('location')} AS location FROM raw", "raw")
def _(t):
    return t.raw.select("url", fn.title_case_clean(F.col("name")).alias("name"), fn.title_case_clean(F.col("location")).alias("location"))


@register("normalize_list_spacing", "SELECT url, regexp_replace(trim(cuisines), '\\s*,\\s*', ', ', 'g') AS cuisines FROM raw", "raw")
def _(t):
    return t.raw.select("url", fn.normalize_list_spacing(F.col("cuisines")).alias("cuisines"))


@register("strip_text", "SELECT conv_id, turn, trim(text, concat(' ', chr(9), chr(10), chr(13))) AS text FROM conversations")
def _(t):
    return t.read("conversations").select("conv_id", "turn", fn.strip_text(F.col("text")).alias("text"))


@register("primary_value", "SELECT url, nullif(trim(split_part(coalesce(cuisines, 'Unknown'), ',', 1)), 'Unknown') AS primary_cuisine FROM raw", "raw")
def _(t):
    return t.raw.select("url", fn.primary_value(F.coalesce("cuisines", F.lit("Unknown"))).alias("primary_cuisine"))


@register(
    "bins",
    f"SELECT url, rate, {_tier('approx_cost')} AS cost_tier, "
    "CASE WHEN rate <= 3 THEN 'low' WHEN rate <= 3.5 THEN 'average' WHEN rate <= 4 THEN 'good' WHEN rate <= 5 THEN 'excellent' END AS rating_tier, "
    "CASE WHEN rate <= 1 THEN NULL WHEN rate <= 2 THEN '1-2 stars' WHEN rate <= 3 THEN '2-3 stars' WHEN rate <= 3.5 THEN '3-3.5 stars' "
    "WHEN rate <= 4 THEN '3.5-4 stars' WHEN rate <= 5 THEN '4-5 stars' END AS rating_bin FROM ent",
    "ent",
)
def _(t):
    return t.ent.select(
        "url",
        "rate",
        fn.bin_cost_tier(F.col("approx_cost")).alias("cost_tier"),
        fn.bin_rating_tier(F.col("rate")).alias("rating_tier"),
        fn.bin_rating_star(F.col("rate")).alias("rating_bin"),
    )


@register("bin_cost_tier", f"SELECT tier, count(*) AS n FROM (SELECT {_tier('l_quantity * 50')} AS tier FROM lineitem) GROUP BY tier")
def _(t):
    tier = fn.bin_cost_tier(F.col("l_quantity") * 50)
    return t.read("lineitem").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


_MEDIAN = rnd("quantile_cont(l_extendedprice, 0.5)", 4) + " AS median"


@register("group_median", f"SELECT l_returnflag, {_MEDIAN} FROM lineitem GROUP BY 1")
def _(t):
    got = group_median(t.read("lineitem"), "l_extendedprice", "l_returnflag")
    return got.withColumn("median", fn.round_half_even(F.col("median"), 4))


@register("group_median_many_groups", f"SELECT l_suppkey, {_MEDIAN} FROM lineitem GROUP BY 1")
def _(t):
    got = group_median(t.read("lineitem"), "l_extendedprice", "l_suppkey")
    return got.withColumn("median", fn.round_half_even(F.col("median"), 4))


@register("global_median", "SELECT " + rnd("median(o_totalprice)", 4) + " AS median FROM orders")
def _(t):
    return global_median(t.read("orders"), "o_totalprice").select(fn.round_half_even(F.col("median"), 4).alias("median"))


def _iqr_sql(table: str, cols: dict[str, float]) -> str:
    parts = []
    for c, floor in cols.items():
        q = f"SELECT '{c}' AS metric, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}"
        parts.append(
            f"SELECT metric, {rnd('q1', 6)} AS q1, {rnd('q3', 6)} AS q3, {rnd('q3 - q1', 6)} AS iqr, "
            f"{rnd(f'greatest({floor}e0, q1 - 1.5e0 * (q3 - q1))', 6)} AS lower, {rnd('q3 + 1.5e0 * (q3 - q1)', 6)} AS upper FROM ({q})"
        )
    return " UNION ALL ".join(parts)


@register("quartiles_iqr", _iqr_sql("lineitem", {"l_extendedprice": 50, "l_quantity": 0}))
def _(t):
    got = quartiles_iqr(t.read("lineitem"), ["l_extendedprice", "l_quantity"], floors={"l_extendedprice": 50, "l_quantity": 0})
    return got.select("metric", *[r6(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


@register(
    "winsorize_iqr",
    "WITH b AS (SELECT event_type, quantile_cont(value, 0.25) OVER () AS q1, quantile_cont(value, 0.75) OVER () AS q3, event_id, value FROM events), "
    "c AS (SELECT event_id, value, greatest(0e0, q1 - 1.5e0 * (q3 - q1)) AS lo, q3 + 1.5e0 * (q3 - q1) AS hi FROM b) "
    "SELECT event_id, " + rnd("least(greatest(value, lo), hi)", 6) + " AS value, CASE WHEN value < lo OR value > hi THEN 1 ELSE 0 END AS value_outlier FROM c",
)
def _(t):
    events = t.read("events").select("event_id", "value")
    got = winsorize_iqr(events, ["value"], floors={"value": 0}, integral=False)
    return got.withColumn("value", r6("value"))


@register(
    "impute_group_median",
    "WITH m AS (SELECT rest_type, median(approx_cost) AS med FROM ent GROUP BY 1), "
    "f AS (SELECT e.url, e.rest_type, coalesce(e.approx_cost, m.med) AS approx_cost FROM ent e LEFT JOIN m ON e.rest_type = m.rest_type) "
    "SELECT url, rest_type, " + rnd("coalesce(approx_cost, (SELECT median(approx_cost) FROM f))", 4) + " AS approx_cost FROM f",
    "ent",
)
def _(t):
    got = impute_group_median(t.ent.select("url", "rest_type", "approx_cost"), "approx_cost", "rest_type")
    return got.withColumn("approx_cost", fn.round_half_even(F.col("approx_cost"), 4))


@register("popularity_score", "SELECT url, " + rnd(f"ln(1 + CAST({_VOTES} AS DOUBLE))", 3) + " AS popularity_score FROM named", "named")
def _(t):
    return t.raw.select("url", fn.popularity_score(fn.parse_count(F.col("votes"))).alias("popularity_score"))


_REVIEWS = f"CASE WHEN {HAS_TEXTS} THEN concat({TEXT_1}, '|', {TEXT_2}) ELSE '' END"
_TEXTS = f"SELECT p_partkey, p_name, CASE WHEN {HAS_TEXTS} THEN 2 ELSE 0 END AS n FROM part"


@register(
    "parse_reviews",
    f"SELECT p_partkey, CASE WHEN {HAS_TEXTS} THEN concat('Rated ', 1 + p_size % 5, '.0:', {TEXT_1}, '|Rated 3.0:Average', chr(92), 'nplace|Rated 1.0: nan ') ELSE '' END AS reviews FROM part",
)
def _(t):
    parsed = fn.parse_reviews(F.col("reviews_list"))
    listings = t.part.select("p_partkey", F.expr(RAW["reviews_list"]).alias("reviews_list"))
    shown = F.array_join(F.transform(parsed, lambda r: F.concat(r["rating"], F.lit(":"), r["text"])), "|")
    return listings.select("p_partkey", shown.alias("reviews"))


@register(
    "review_texts",
    f"SELECT p_partkey, {_REVIEWS} AS texts, CASE WHEN {HAS_TEXTS} THEN 2 ELSE 0 END AS review_count, CASE WHEN {HAS_TEXTS} THEN 1 ELSE 0 END AS has_reviews FROM part",
)
def _(t):
    listings = t.part.select("p_partkey", F.expr(RAW["reviews_list"]).alias("reviews_list"))
    got = ops.parse_reviews_column(listings)
    return got.select("p_partkey", F.array_join("review_texts", "|").alias("texts"), "review_count", fn.has_reviews(F.col("review_count")).alias("has_reviews"))


@register(
    "parse_reviews_json",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS STRING) AS text FROM events",
)
def _(t):
    as_list = F.format_string('[{"rating":"Rated 1.0","text":"%s"}]', F.get_json_object("props", "$.k"))
    reviews = fn.parse_reviews(as_list, form="json")
    return t.read("events").select("event_id", fn.review_texts(reviews)[0].alias("text"))


@register("explode_reviews", "SELECT * FROM doc_lines", "doc_lines")
def _(t):
    return explode_reviews(t.nested)


@register("non_blank_text", "SELECT page_id, html FROM pages WHERE trim(html) <> '' AND lower(trim(html)) <> 'nan'")
def _(t):
    return non_blank_text(t.read("pages").select("page_id", "html"), "html", drop_nan=True)


@register("unescape_newline", f"SELECT conv_id, turn, trim(replace(concat(role, {BS}, 'n', {NL}, text), concat({BS}, 'n'), ' '), concat(' ', chr(9), chr(10), chr(13))) AS text FROM conversations")
def _(t):
    text = F.concat(F.col("role"), F.lit("\\n\n"), F.col("text"))
    return t.read("conversations").select("conv_id", "turn", fn.unescape_newline(text).alias("text"))


@register("value_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def _(t):
    return value_counts(t.read("events"), "event_type")


@register(
    "column_profile",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'string' AS dtype, {rnd(f'avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100', 6)} AS null_pct, count(DISTINCT {c}) AS distinct_values FROM named"
        for c in _SHORT.values()
    )
    + ")",
    "named",
)
def _(t):
    return quality.column_profile(ops.normalize_column_names(t.raw)).withColumn("null_pct", r6("null_pct"))


@register("column_profile_approx")
def _(t):
    return quality.column_profile(t.read("orders"), approx=True)


@register(
    "validate",
    "SELECT 'in_range' AS \"check\", 'rate' AS \"column\", count(*) FILTER (rate < 1 OR rate > 5) AS violations, 'PASS' AS status FROM ent "
    "UNION ALL SELECT 'min_rows', 'all', greatest(1000 - count(*), 0), CASE WHEN count(*) >= 1000 THEN 'PASS' ELSE 'FAIL' END FROM ent "
    "UNION ALL SELECT 'unique', 'name', count(*) - count(DISTINCT name), CASE WHEN count(*) = count(DISTINCT name) THEN 'PASS' ELSE 'FAIL' END FROM ent",
    "ent",
)
def _(t):
    return quality.validate(t.ent, key="name")


# the whole job
CTES["parsed"] = (
    ("uniq",),
    "SELECT "
    + _FILLED.replace("coalesce(reviews_list, '') AS reviews_list", "coalesce(reviews_list, '') AS reviews_list, CASE WHEN rate IS NULL THEN 1 ELSE 0 END AS rate_missing")
    .replace(" rate,", f" {_RATE} AS rate,")
    .replace(" votes,", f" {_VOTES} AS votes,")
    .replace(" approx_cost,", f" {_COST} AS approx_cost,")
    + " FROM uniq WHERE name IS NOT NULL",
)
CTES["type_median"] = (("parsed",), "SELECT rest_type, median(approx_cost) AS med FROM parsed GROUP BY 1")
CTES["group_filled"] = (
    ("parsed", "type_median"),
    "SELECT p.* REPLACE (coalesce(p.approx_cost, m.med) AS approx_cost) FROM parsed p LEFT JOIN type_median m ON p.rest_type = m.rest_type",
)
CTES["filled"] = (
    ("group_filled",),
    "SELECT * REPLACE (CAST(round_even(coalesce(approx_cost, (SELECT median(approx_cost) FROM group_filled)), 0) AS BIGINT) AS approx_cost) FROM group_filled",
)
CTES["bounds"] = (
    ("filled",),
    "SELECT greatest(0e0, v1 - 1.5e0 * (v3 - v1)) AS vlo, v3 + 1.5e0 * (v3 - v1) AS vhi, greatest(50e0, c1 - 1.5e0 * (c3 - c1)) AS clo, c3 + 1.5e0 * (c3 - c1) AS chi "
    "FROM (SELECT quantile_cont(CAST(votes AS DOUBLE), 0.25) AS v1, quantile_cont(CAST(votes AS DOUBLE), 0.75) AS v3, "
    "quantile_cont(CAST(approx_cost AS DOUBLE), 0.25) AS c1, quantile_cont(CAST(approx_cost AS DOUBLE), 0.75) AS c3 FROM filled)",
)
_CAPPED_VOTES = "CASE WHEN votes IS NOT NULL THEN CAST(round_even(least(greatest(CAST(votes AS DOUBLE), vlo), vhi), 0) AS BIGINT) END"
_PARSES = "reviews_list LIKE '[(%'"
_CLEAN_SQL = (
    f"SELECT url, trim(address) AS address, {_title('name')} AS name, online_order, book_table, rate, {_CAPPED_VOTES} AS votes, phone, "
    f"{_title('location')} AS location, {_title('rest_type')} AS rest_type, dish_liked, regexp_replace(trim(cuisines), '\\s*,\\s*', ', ', 'g') AS cuisines, "
    "CASE WHEN approx_cost IS NOT NULL THEN CAST(round_even(least(greatest(CAST(approx_cost AS DOUBLE), clo), chi), 0) AS BIGINT) END AS approx_cost, menu_item, "
    f"{_title('listed_type')} AS listed_type, {_title('listed_city')} AS listed_city, rate_missing, {_tier('approx_cost')} AS cost_tier, "
    f"{_YES.format('online_order')} AS online_order_enc, {_YES.format('book_table')} AS book_table_enc, "
    "CASE WHEN votes < vlo OR votes > vhi THEN 1 ELSE 0 END AS votes_outlier, CASE WHEN approx_cost < clo OR approx_cost > chi THEN 1 ELSE 0 END AS approx_cost_outlier, "
    f"CASE WHEN {_PARSES} THEN 2 ELSE 0 END AS review_count, CASE WHEN {_PARSES} THEN 1 ELSE 0 END AS has_reviews, "
    "CASE WHEN rate <= 3 THEN 'low' WHEN rate <= 3.5 THEN 'average' WHEN rate <= 4 THEN 'good' WHEN rate <= 5 THEN 'excellent' END AS rating_tier, "
    f"nullif(trim(split_part(cuisines, ',', 1)), 'Unknown') AS primary_cuisine, {rnd(f'ln(1 + CAST({_CAPPED_VOTES} AS DOUBLE))', 3)} AS popularity_score FROM filled, bounds"
)


@register("clean_listings", _CLEAN_SQL, "filled", "bounds")
def _(t):
    return clean_listings(t.raw).drop("reviews_list", "review_texts")


_FILLED = ("online_order", "book_table", "cuisines", "rest_type", "location", "listed_type", "listed_city", "reviews_list", "dish_liked", "menu_item", "phone", "address")
_WHOLE = (  # steps that touch every row that is left
    "feature/cost_tier", "text/name", "text/location", "text/listed_type", "text/listed_city", "text/rest_type", "text/cuisines", "text/address",
    "feature/rating_tier", "feature/primary_cuisine", "feature/popularity_score",
)
_UNCOUNTED = ("encode/online_order", "encode/book_table", "impute/approx_cost", "parse/reviews_list", "feature/has_reviews")  # have queries of their own


@register(
    "cleaning_audit",
    "SELECT * FROM (SELECT 'load' AS step, 'all' AS \"column\", (SELECT count(*) FROM named) AS rows_affected "
    "UNION ALL SELECT 'column_names', 'all', 0 "
    "UNION ALL SELECT 'duplicates', 'all_columns', 0 "
    "UNION ALL SELECT 'duplicates', 'url', (SELECT count(*) FROM named) - (SELECT count(*) FROM uniq) "
    "UNION ALL SELECT 'duplicates', 'all', (SELECT count(*) FROM named) - (SELECT count(*) FROM uniq) "
    "UNION ALL SELECT 'missing', 'name', count(*) FILTER (name IS NULL) FROM uniq "
    "UNION ALL SELECT 'missing', 'rate', count(*) FILTER (name IS NOT NULL AND rate IS NULL) FROM uniq "
    + "".join(f"UNION ALL SELECT 'missing', '{c}', count(*) FILTER (name IS NOT NULL AND {c} IS NULL) FROM uniq " for c in _FILLED)
    + "".join("UNION ALL SELECT '{}', '{}', count(*) FROM filled ".format(*w.split("/")) for w in _WHOLE)
    + "UNION ALL SELECT 'parse', 'votes', count(votes) FROM filled "
    "UNION ALL SELECT 'parse', 'rate', count(rate) FROM filled "
    "UNION ALL SELECT 'outliers', 'votes', count(*) FILTER (votes < vlo OR votes > vhi) FROM filled, bounds "
    "UNION ALL SELECT 'outliers', 'approx_cost', count(*) FILTER (approx_cost < clo OR approx_cost > chi) FROM filled, bounds)",
    "filled",
    "bounds",
)
def _(t):
    audit = cleaning_audit(t.raw, clean_listings(t.raw))
    return audit.where(~F.concat_ws("/", "step", "column").isin(*_UNCOUNTED)).select("step", "column", "rows_affected")


_REPORTED = ("url", "name", "rest_type", "listed_city", "online_order", "rate", "approx_cost")


@register(
    "cleaning_report",
    " UNION ALL ".join(f"SELECT count(*) AS rows, CAST({len(_REPORTED)} AS INT) AS columns, '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM ent" for c in _REPORTED),
    "ent",
)
def _(t):
    report = quality.cleaning_report(t.ent)
    return report.select("final_shape.*", F.explode("final_columns").alias("column"), "null_summary").select("rows", "columns", "column", F.col("null_summary")[F.col("column")].alias("nulls"))


@register("cleaning_summary")
def _(t):
    return quality.cleaning_summary(clean_listings(t.raw))
