"""The building blocks that other queries use only inside larger ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from patronvoice import functions as fn
from patronvoice.operators import breakdowns as b
from patronvoice.operators import cleaning as cleaning_ops
from patronvoice.operators import planning
from patronvoice.operators import topics as topic_ops
from patronvoice.operators.quality import audit_record, audit_rows
from patronvoice.sources.fixed import RECOMMENDATIONS, recommendations
from registry.base import RAW, r6, register, rnd
from registry.planning import _features, advice_sql, whole_advice

_TIER = "CASE WHEN {0} <= 0 OR {0} > 5 THEN NULL WHEN {0} <= 3 THEN 'low' WHEN {0} <= 3.5 THEN 'average' WHEN {0} <= 4 THEN 'good' WHEN {0} <= 5 THEN 'excellent' END"
_STAR = "CASE WHEN {0} <= 1 OR {0} > 5 THEN NULL WHEN {0} <= 2 THEN '1-2 stars' WHEN {0} <= 3 THEN '2-3 stars' WHEN {0} <= 3.5 THEN '3-3.5 stars' WHEN {0} <= 4 THEN '3.5-4 stars' WHEN {0} <= 5 THEN '4-5 stars' END"


@register("bin_rating_tier", f"SELECT {_TIER.format('(l_quantity / 10)')} AS tier, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    tier = fn.bin_rating_tier(F.col("l_quantity") / 10)
    return t.read("lineitem").groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@register("bin_rating_star", f"SELECT {_STAR.format('(l_quantity / 10)')} AS star, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    star = fn.bin_rating_star(F.col("l_quantity") / 10)
    return t.read("lineitem").groupBy(star.alias("star")).agg(F.count(F.lit(1)).alias("n"))


@register("null_count_per_row", "SELECT p_partkey, CASE WHEN phone IS NULL THEN 1 ELSE 0 END + CASE WHEN name IS NULL THEN 1 ELSE 0 END + CASE WHEN votes IS NULL THEN 1 ELSE 0 END AS nulls FROM "
    f"(SELECT p_partkey, {RAW['phone']} AS phone, {RAW['name']} AS name, {RAW['votes']} AS votes FROM part)")
def _(t):
    cols = ["phone", "name", "votes"]
    rows = t.part.selectExpr("p_partkey", *[f"{RAW[c]} AS {c}" for c in cols])
    return rows.select("p_partkey", cleaning_ops.null_count_per_row(cols).alias("nulls"))


_LINES = "string_split(text, chr(10))"


@register("review_count", f"SELECT doc_id, CAST(len({_LINES}) AS INT) AS review_count FROM documents")
def _(t):
    return t.nested.select(F.col("url").alias("doc_id"), fn.review_count(F.col("review_texts")).alias("review_count"))


@register("has_reviews", f"SELECT doc_id, CASE WHEN len({_LINES}) > 3 THEN 1 ELSE 0 END AS has_reviews FROM documents")
def _(t):
    more = fn.review_count(F.col("review_texts")) - 3
    return t.nested.select(F.col("url").alias("doc_id"), fn.has_reviews(more).alias("has_reviews"))


@register("complement_pct", "SELECT l_linenumber, count(*) AS n, " + rnd("sum(" + rnd("greatest(least(100e0 - l_quantity - l_discount * 1000, 100e0), 0e0)", 1) + ")", 1) + " AS rest FROM lineitem GROUP BY 1")
def _(t):
    rest = fn.complement_pct(F.col("l_quantity"), F.col("l_discount") * 1000)
    got = t.read("lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(rest).alias("rest"))
    return got.withColumn("rest", fn.round_half_even(F.col("rest"), 1))


def _weights(t):
    words = F.array("p_name", "p_brand", "p_type")
    values = F.array(*[F.col("p_partkey") % m / F.lit(float(d)) for m, d in ((97, 7), (89, 11), (83, 13))])
    return t.part.select("p_partkey", fn.keyword_weight_map(words, values, 2).alias("kw_weights"))


@register("keyword_weight_map", "SELECT p_partkey, concat(p_name, ',', p_brand) AS words, " + rnd(rnd("(p_partkey % 97) / 7e0", 4) + " + " + rnd("(p_partkey % 89) / 11e0", 4), 4) + " AS total FROM part")
def _(t):
    total = F.aggregate(F.map_values("kw_weights"), F.lit(0.0), lambda a, x: a + x)
    words = F.array_join(F.map_keys("kw_weights"), ",")
    return _weights(t).select("p_partkey", words.alias("words"), fn.round_half_even(total, 4).alias("total"))


@register("map_items_top", "SELECT p_partkey, p_name AS word, " + rnd("(p_partkey % 97) / 7e0", 4) + " AS weight FROM part")
def _(t):
    first = fn.map_items_top(F.col("kw_weights"), 1)[0]
    return _weights(t).select("p_partkey", first["key"].alias("word"), first["value"].alias("weight"))


@register("join_keywords", "SELECT p_partkey, concat(p_brand, ', ', p_type) AS keywords FROM part")
def _(t):
    return t.part.select("p_partkey", fn.join_keywords(F.array("p_brand", "p_type")).alias("keywords"))


@register("dominant_complaint", "SELECT url, dominant_complaint FROM complaints", "complaints")
def _(t):
    return topic_ops.complaint_features(t.lines_topics).select("url", "dominant_complaint")


@register("complaint_diversity", "SELECT complaint_diversity, count(*) AS entities FROM complaints GROUP BY 1", "complaints")
def _(t):
    got = topic_ops.complaint_features(t.lines_topics)
    return got.groupBy("complaint_diversity").agg(F.count(F.lit(1)).alias("entities"))


@register("complaint_review_count", "SELECT url, complaint_review_count FROM ent_c", "ent_c")
def _(t):
    return t.ent_c.select("url", "complaint_review_count")


@register("complaint_topic_counts", "SELECT url, topic_label, n FROM complaint_counts", "complaint_counts")
def _(t):
    got = topic_ops.complaint_features(t.lines_topics)
    return got.select("url", F.explode("complaint_topic_counts").alias("topic_label", "n"))


@register("mean_by_group", "SELECT l_returnflag, " + rnd("avg(l_quantity)", 1) + " AS l_quantity, " + rnd("avg(l_discount)", 1) + " AS l_discount FROM lineitem GROUP BY 1")
def _(t):
    return b.mean_by_group(t.read("lineitem"), "l_returnflag", ["l_quantity", "l_discount"])


@register("histogram", "SELECT l_returnflag, CAST(least(floor(l_quantity / 5e0), 9) AS INT) AS bin, count(*) AS count, least(floor(l_quantity / 5e0), 9) * 5e0 AS bin_start FROM lineitem GROUP BY ALL")
def _(t):
    return b.histogram(t.read("lineitem"), "l_quantity", ["l_returnflag"], 0, 50, 10)


@register("histogram_auto", 
    "WITH r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events), "
    "g AS (SELECT value, lo, w, least(CAST(floor((value - lo) / w) AS INT), 49) AS g FROM events, r WHERE value IS NOT NULL), "
    "f AS (SELECT lo, w, CASE WHEN value < lo + CAST(g AS DOUBLE) * w THEN g - 1 WHEN g < 49 AND value >= lo + CAST(g + 1 AS DOUBLE) * w THEN g + 1 ELSE g END AS bin FROM g) "
    "SELECT CAST(bin AS INT) AS bin, count(*) AS count, lo + bin * w AS bin_start FROM f GROUP BY bin, lo, w",
)
def _(t):
    return b.histogram(t.read("events"), "value", [], None, None, 50)


@register(
    "crosstab_pct_by_row",
    "WITH f AS (SELECT r.i AS row_order, r.o_orderstatus, p.o_orderpriority, (SELECT count(*) FROM orders o WHERE o.o_orderstatus = r.o_orderstatus AND o.o_orderpriority = p.o_orderpriority) AS count "
    "FROM (VALUES (0, 'P'), (1, 'O'), (2, 'F'), (3, 'absent')) r(i, o_orderstatus), (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) p) "
    "SELECT *, CASE WHEN sum(count) OVER (PARTITION BY o_orderstatus) > 0 THEN " + rnd("count / sum(count) OVER (PARTITION BY o_orderstatus) * 100", 6) + " END AS pct FROM f",
)
def _(t):
    orders = t.read("orders")
    kept = b.semi_join_top_k(orders, "o_orderpriority", 3)
    top = b.top_categories(orders, "o_orderpriority", 3)
    got = b.crosstab_pct_by_row(kept, "o_orderstatus", "o_orderpriority", ["P", "O", "F", "absent"], top)
    return got.withColumn("pct", r6("pct"))


@register("group_share", "SELECT p_type, p_brand, count(*) AS count, " + rnd("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY p_type) * 100", 6) + " AS pct FROM part GROUP BY 1, 2")
def _(t):
    return b.group_share(b.crosstab_counts(t.part, "p_type", "p_brand"), "count", "p_type").withColumn("pct", r6("pct"))


@register("display_row_number", "SELECT p_brand, count(*) AS count, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INT) AS row FROM part GROUP BY 1 ORDER BY count DESC, p_brand LIMIT 10")
def _(t):
    return b.display_row_number(b.top_categories(t.part, "p_brand", 10), [F.desc("count"), "p_brand"])


@register("random_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42#', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 500")
def _(t):
    return b.random_sample(t.read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@register("top_topics", "SELECT topic_id, frequency FROM topic_table WHERE topic_id <> -1 ORDER BY frequency DESC, topic_id LIMIT 8", "topic_table")
def _(t):
    return b.top_topics(t.topic_table, 8).select("topic_id", "frequency")


@register("nonzero_keyword_weight", "SELECT topic_id, topic_label, frequency FROM topic_table WHERE topic_id <> -1 AND frequency > (SELECT avg(frequency) FROM topic_table)", "topic_table")
def _(t):
    frequent = F.col("frequency") > t.topic_table.agg(F.avg("frequency")).scalar()
    weights = F.when(frequent, F.create_map(F.lit("word"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    got = b.topic_keyword_weights(t.topic_table.withColumn("kw_weights", weights), k=100)
    return got.select("topic_id", "topic_label").join(t.topic_table.select("topic_id", "frequency"), "topic_id")


@register("rice_filter", "SELECT feature, sprint, topic FROM features WHERE sprint = 2 AND topic = 'SMALL'", "features")
def _(t):
    return planning.rice_filter(_features(t), 2, "SMALL").select("feature", "sprint", "topic")


@register("recommendation_filter", advice_sql(RECOMMENDATIONS[1][0]), "topic_table")
def _(t):
    return whole_advice(planning.recommendations_by_topic(t.topic_table, recommendations(t.spark), RECOMMENDATIONS[1][0]))


@register(
    "audit_record",
    "SELECT 'missing' AS step, 'quality' AS \"column\", 'without label' AS action, count(*) FILTER (l.doc_id IS NULL) AS rows_affected, concat(count(*), ' documents') AS detail "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def _(t):
    joined = t.read("documents").join(t.read("labels"), "doc_id", "left")
    total = F.format_string("%d documents", F.count(F.lit(1)))
    record = audit_record("missing", "quality", "without label", F.count_if(F.col("quality").isNull()), total)
    return audit_rows(joined, [record])
