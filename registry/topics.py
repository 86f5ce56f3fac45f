"""Topic queries: texts from ``documents``, assignments from ``lineitem``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from patronvoice import functions as fn
from patronvoice.operators import breakdowns as b
from patronvoice.operators import search as s
from patronvoice.operators import terms as terms_ops
from patronvoice.operators import topics as ops
from patronvoice.operators.search_index import build_search_index
from patronvoice.plans.topics import min_token_filter, negative_entity_reviews
from patronvoice.session import ensure_checkpoint_dir
from patronvoice.sources.fixed import TAXONOMY
from registry.base import CTES, SPACES, r6, register, rnd



def _cleaned(c: str) -> str:
    text = f"regexp_replace({c}, 'http[^{SPACES}]+|www[^{SPACES}]+', '', 'g')"
    text = f"regexp_replace({text}, '[^\\p{{L}}\\p{{N}}_{SPACES}.,!?''-]', ' ', 'g')"
    text = f"regexp_replace({text}, '[{SPACES}]+', ' ', 'g')"
    text = f"regexp_replace({text}, '\\.{{2,}}', '.', 'g')"
    return f"regexp_replace({text}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


CTES["clean_docs"] = ((), f"SELECT doc_id, lang, source, {_cleaned('text')} AS text FROM documents")
_TOKENS = f"len(regexp_extract_all(text, '[^{SPACES}]+'))"


@register("clean_review_text", "SELECT doc_id, text FROM clean_docs", "clean_docs")
def _(t):
    return t.documents.select("doc_id", fn.clean_review_text(F.col("text")).alias("text"))


@register("min_token_filter", f"SELECT doc_id, text FROM documents WHERE {_TOKENS} >= 50")
def _(t):
    return min_token_filter(t.documents.select("doc_id", "text"), "text", 50)


def doc_entities(t):
    """Documents with their lines as reviews and their own class as the dominant one."""
    own = t.docs_scored.select(F.col("review_id").alias("url"), F.col("sentiment").alias("dominant_sentiment"))
    return t.nested.join(own, "url")


@register(
    "negative_entity_reviews",
    "WITH c AS (SELECT d.url, d.review_pos, s.sentiment, " + _cleaned("d.review_text") + " AS text FROM doc_lines d JOIN docs_scored s ON d.url = s.review_id), "
    f"k AS (SELECT * FROM c WHERE {_TOKENS} >= 5) "
    "SELECT url, review_pos, text AS review_text FROM k WHERE sentiment = 'negative' OR NOT EXISTS (SELECT 1 FROM k WHERE sentiment = 'negative')",
    "doc_lines",
    "docs_scored",
)
def _(t):
    return negative_entity_reviews(doc_entities(t)).select("url", "review_pos", "review_text")


@register(
    "negative_reviews",
    "WITH c AS (SELECT review_id, sentiment, " + _cleaned("review_text") + f" AS text FROM docs_scored) SELECT review_id, text AS review_text FROM c WHERE sentiment = 'negative' AND {_TOKENS} >= 5",
    "docs_scored",
)
def _(t):
    rows = t.docs_scored.select("review_id", "review_text", "sentiment")
    return negative_entity_reviews(rows, level="review").select("review_id", "review_text")


CTES["words"] = ((), "SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents")
_FREQ = (
    "SELECT lang, term, count(*) AS tf FROM words GROUP BY 1, 2"
)
CTES["counts"] = (
    ("words",),
    f"SELECT * FROM ({_FREQ}) WHERE term IN (SELECT term FROM words GROUP BY term HAVING count(DISTINCT doc_id) >= 5 "
    "AND count(DISTINCT doc_id) <= 0.9e0 * (SELECT count(*) FROM documents))",
)
CTES["weighted"] = (
    ("counts",),
    "SELECT lang, term, tf, tf / sum(tf) OVER (PARTITION BY lang) * ln(1 + (SELECT sum(tf) / count(DISTINCT lang) FROM counts) / sum(tf) OVER (PARTITION BY term)) AS weight FROM counts",
)


def _counts(t, max_features=None, ngrams=(1, 1)):
    return terms_ops.term_counts(t.documents, "text", "lang", ngrams, 5, 0.90, max_features)


@register("term_counts", "SELECT lang, term, tf FROM counts", "counts")
def _(t):
    return _counts(t)


@register("term_counts_top", "SELECT lang, term, tf FROM counts WHERE term IN (SELECT term FROM counts GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 200)", "counts")
def _(t):
    return _counts(t, max_features=200)


CTES["listed"] = ((), "SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}'), lambda w: w NOT IN ('the', 'of', 'der', 'la')) AS w FROM documents")
CTES["grams"] = (
    ("listed",),
    "SELECT doc_id, lang, unnest(list_concat(w, [concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))])) AS term FROM listed",
)


@register(
    "term_counts_bigrams",
    "SELECT lang, term, count(*) AS tf FROM grams WHERE term IN (SELECT term FROM grams GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) <= 0.9e0 * (SELECT count(*) FROM documents)) GROUP BY 1, 2",
    "grams",
)
def _(t):
    return terms_ops.term_counts(t.documents, "text", "lang", (1, 2), 5, 0.90, None, stop=["the", "of", "der", "la"])


@register("class_tfidf", f"SELECT lang, term, tf, {rnd('weight', 6)} AS weight FROM weighted", "weighted")
def _(t):
    return terms_ops.class_tfidf(_counts(t), "lang").withColumn("weight", r6("weight"))


CTES["ranked"] = (
    ("weighted",),
    f"SELECT lang, term, w AS weight, row_number() OVER (PARTITION BY lang ORDER BY w DESC, term) AS rank FROM (SELECT lang, term, {rnd('weight', 9)} AS w FROM weighted) QUALIFY rank <= 10",
)


def _weights(t):
    weights = terms_ops.class_tfidf(_counts(t), "lang")
    return weights.withColumn("weight", fn.round_half_even(F.col("weight"), 9))


@register("top_keywords", f"SELECT lang, string_agg(concat(rank, ':', term), ',' ORDER BY rank) AS keywords, {rnd('sum(' + rnd('weight', 4) + ')', 4)} AS weight FROM ranked GROUP BY 1", "ranked")
def _(t):
    top = terms_ops.top_keywords(_weights(t), "lang", 10)
    shown = F.array_join(F.transform("keywords", lambda w, i: F.concat_ws(":", i + 1, w)), ",")
    total = F.aggregate(F.map_values("kw_weights"), F.lit(0.0), lambda a, x: a + x)
    return top.select("lang", shown.alias("keywords"), fn.round_half_even(total, 4).alias("weight"))


@register(
    "topic_summary",
    "SELECT d.lang, d.n AS frequency, "
    + rnd("CAST(d.n AS DOUBLE) / (SELECT count(*) FROM documents) * 100", 2)
    + " AS pct, k.keywords FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) d "
    "LEFT JOIN (SELECT lang, string_agg(term, ',' ORDER BY rank) AS keywords FROM ranked GROUP BY 1) k ON d.lang = k.lang",
    "ranked",
)
def _(t):
    keywords = terms_ops.top_keywords(_weights(t), "lang", 10)
    got = ops.topic_summary(t.documents, keywords, "lang")
    return got.select("lang", "frequency", "pct", F.array_join("keywords", ",").alias("keywords"))


# keyword lists made of part names and taxonomy words
_KW = {
    "p_partkey": "p_partkey",
    "k1": "split_part(p_name, ' ', 1)",
    "k2": "CASE p_partkey % 5 WHEN 0 THEN 'dirty' WHEN 1 THEN 'late' WHEN 2 THEN 'item' WHEN 3 THEN 'Refund' ELSE 'zinc' END",
    "k3": "CASE p_size % 4 WHEN 0 THEN 'menu' WHEN 1 THEN 'box' WHEN 2 THEN 'quartz' ELSE 'delay' END",
}
_KW_LIST = ", ".join(f"{e} AS {n}" for n, e in _KW.items())
_OVERLAP = " UNION ALL ".join(
    f"SELECT p_partkey, {i} AS ordinal, '{label}' AS label, len(list_intersect(list_distinct([lower(k1), lower(k2), lower(k3)]), {list(signals)})) AS overlap FROM kw"
    for i, (label, signals) in enumerate(TAXONOMY)
)


@register(
    "derive_label",
    f"WITH kw AS (SELECT {_KW_LIST} FROM part), o AS ({_OVERLAP}), "
    "best AS (SELECT p_partkey, first(label ORDER BY overlap DESC, ordinal) AS label, max(overlap) AS overlap FROM o GROUP BY 1), "
    "joined AS (SELECT *, concat(k1, ' / ', k2, ' / ', k3) AS j FROM kw) "
    "SELECT j.p_partkey, CASE WHEN b.overlap > 0 THEN b.label ELSE array_to_string(list_transform(regexp_extract_all(j.j, '\\p{L}+|[^\\p{L}]+'), lambda w: concat(upper(w[1]), lower(w[2:]))), '') END AS topic_label "
    "FROM joined j JOIN best b ON j.p_partkey = b.p_partkey",
)
def _(t):
    kw = t.part.selectExpr(*[f"{e} AS {n}" for n, e in _KW.items()])
    return kw.select("p_partkey", fn.derive_label(F.array("k1", "k2", "k3"), TAXONOMY).alias("topic_label"))


@register(
    "label_topics",
    "SELECT CASE WHEN topic_id = -1 THEN 'unknown' ELSE topic_label END AS topic_label, count(*) AS n FROM lines_topics GROUP BY 1",
    "lines_topics",
)
def _(t):
    known = ops.not_noise(t.topic_table)
    return ops.label_topics(t.lines, known).groupBy("topic_label").agg(F.count(F.lit(1)).alias("n"))


_COMPLAINT_COLS = "url, dominant_complaint, complaint_diversity, complaint_review_count, complaint_topic_counts"


@register("complaint_features", f"SELECT {_COMPLAINT_COLS} FROM complaints", "complaints")
def _(t):
    return _flat(ops.complaint_features(t.lines_topics))


def _flat(df):
    entries = F.transform(F.map_entries("complaint_topic_counts"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.select(
        "url", "dominant_complaint", "complaint_diversity", "complaint_review_count", F.array_join(entries, ";").alias("complaint_topic_counts")
    )


@register("map_topics_to_entities", f"SELECT {_COMPLAINT_COLS} FROM ent_c", "ent_c")
def _(t):
    return _flat(ops.map_topics_to_entities(t.ent, t.lines_topics))


@register("not_noise", "SELECT url, topic_id FROM lines WHERE topic_id <> -1", "lines")
def _(t):
    return ops.not_noise(t.lines.select("url", "topic_id"))


@register(
    "topic_report",
    "SELECT count(*) FILTER (topic_id <> -1) AS n_topics, (sum(frequency) FILTER (topic_id <> -1))::BIGINT AS n_reviews_clustered, "
    "max(pct) FILTER (topic_id = -1) AS noise_pct, string_agg(concat(topic_id, ':', frequency), ',' ORDER BY frequency DESC, topic_id) FILTER (topic_id <> -1) AS topics FROM topic_table",
    "topic_table",
)
def _(t):
    report = ops.topic_report(t.topic_table)
    records = F.transform("topics", lambda r: F.concat_ws(":", r["topic_id"], r["frequency"]))
    return report.select("n_topics", "n_reviews_clustered", "noise_pct", F.array_join(records, ",").alias("topics"))


_TOPIC_COLS = "topic_id, topic_label, frequency, pct"


@register("topic_frequency", f"SELECT {_TOPIC_COLS} FROM topic_table WHERE topic_id <> -1 ORDER BY frequency DESC, topic_id LIMIT 10", "topic_table")
def _(t):
    return b.topic_frequency(t.topic_table)


@register("top_complaint_topics", f"SELECT {_TOPIC_COLS} FROM topic_table WHERE topic_id <> -1 ORDER BY frequency DESC, topic_id LIMIT 5", "topic_table")
def _(t):
    return b.top_complaint_topics(t.topic_table, k=5)


@register("topic_frequency_full", f"SELECT {_TOPIC_COLS} FROM topic_table", "topic_table")
def _(t):
    return b.topic_frequency_full(t.topic_table)


def _lang_topics(t):
    """The languages as topics, numbered 0 to 3, with keywords."""
    number = F.expr("CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END")
    keywords = terms_ops.top_keywords(_weights(t), "lang", 10)
    return ops.topic_summary(t.documents, keywords, "lang").withColumn("topic_id", number)


CTES["lang_topics"] = (
    (),
    "SELECT lang, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS topic_id, count(*) AS frequency FROM documents GROUP BY 1",
)


@register(
    "topic_keyword_weights",
    "SELECT t.topic_id, CAST(r.rank - 1 AS INT) AS position, r.term AS word, " + rnd("r.weight", 4) + " AS weight FROM "
    "(SELECT * FROM lang_topics ORDER BY frequency DESC, topic_id LIMIT 3) t JOIN ranked r ON t.lang = r.lang WHERE r.rank <= 8",
    "lang_topics",
    "ranked",
)
def _(t):
    return b.topic_keyword_weights(_lang_topics(t), k=3, words=8).drop("topic_label")


@register(
    "topic_listing",
    "SELECT t.topic_id, t.frequency, string_agg(r.term, ', ' ORDER BY r.rank) AS keywords FROM lang_topics t JOIN ranked r ON t.lang = r.lang WHERE r.rank <= 5 GROUP BY ALL",
    "lang_topics",
    "ranked",
)
def _(t):
    return b.topic_listing(_lang_topics(t)).select("topic_id", "frequency", "keywords")


@register(
    "topic_deep_dive",
    "SELECT t.frequency, string_agg(r.term, '|' ORDER BY r.rank) AS keywords FROM lang_topics t JOIN ranked r ON t.lang = r.lang WHERE r.rank <= 8 GROUP BY ALL",
    "lang_topics",
    "ranked",
)
def _(t):
    exported = ops.topics_for_export(_lang_topics(t))
    return b.topic_deep_dive(exported, keyword_text=True).select("frequency", F.array_join("keywords", "|").alias("keywords"))


@register("split_keywords", "SELECT p_partkey, array_to_string(list_transform(split(concat(p_name, ' , ', p_brand, ',', p_type), ','), lambda w: trim(w))[1:2], '|') AS words FROM part")
def _(t):
    text = F.concat("p_name", F.lit(" , "), "p_brand", F.lit(","), "p_type")
    return t.part.select("p_partkey", F.array_join(fn.split_keywords(text, 2), "|").alias("words"))


@register("short_name", "SELECT c_custkey, substring(c_name, 1, 12) AS name, CASE WHEN contains(c_mktsegment, '_') THEN split_part(c_mktsegment, '_', 2) ELSE substring(c_mktsegment, 1, 12) END AS segment FROM customer")
def _(t):
    return t.read("customer").select("c_custkey", fn.short_name(F.col("c_name"), 12).alias("name"), fn.topic_short_name(F.col("c_mktsegment")).alias("segment"))


_TOP_TOPICS = "(SELECT DISTINCT topic_label FROM (SELECT * FROM topic_table WHERE topic_id <> -1 ORDER BY frequency DESC, topic_id LIMIT {0}))"


@register(
    "topic_by_type_heatmap",
    "WITH types AS (SELECT rest_type, CAST(row_number() OVER (ORDER BY n DESC, rest_type) AS INT) AS type_rank FROM (SELECT rest_type, count(*) AS n FROM ent_c GROUP BY 1 ORDER BY n DESC, rest_type LIMIT 4)) "
    "SELECT e.dominant_complaint, e.rest_type, t.type_rank, count(*) AS count, "
    + rnd("CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY e.rest_type) * 100", 6)
    + f" AS pct FROM ent_c e JOIN types t ON e.rest_type = t.rest_type WHERE e.dominant_complaint IN {_TOP_TOPICS.format(5)} GROUP BY 1, 2, 3",
    "ent_c",
    "topic_table",
)
def _(t):
    return b.topic_by_type_heatmap(t.ent_c, t.topic_table, 5, 4).withColumn("pct", r6("pct"))


_STAR = "CASE WHEN rate <= 1 THEN NULL WHEN rate <= 2 THEN '1-2 stars' WHEN rate <= 3 THEN '2-3 stars' WHEN rate <= 3.5 THEN '3-3.5 stars' WHEN rate <= 4 THEN '3.5-4 stars' WHEN rate <= 5 THEN '4-5 stars' END"


@register(
    "topics_over_rating",
    "WITH bins AS (SELECT * FROM (VALUES (0, '1-2 stars'), (1, '2-3 stars'), (2, '3-3.5 stars'), (3, '3.5-4 stars'), (4, '4-5 stars')) v(row_order, rating_bin)), "
    f"tops AS (SELECT topic_label AS dominant_complaint FROM {_TOP_TOPICS.format(5)}), "
    f"n AS (SELECT {_STAR} AS rating_bin, dominant_complaint, count(*) AS n FROM ent_c GROUP BY 1, 2), "
    "f AS (SELECT b.row_order, b.rating_bin, t.dominant_complaint, coalesce(n.n, 0) AS count FROM bins b CROSS JOIN tops t LEFT JOIN n ON n.rating_bin = b.rating_bin AND n.dominant_complaint = t.dominant_complaint) "
    "SELECT *, CASE WHEN sum(count) OVER (PARTITION BY rating_bin) > 0 THEN " + rnd("CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY rating_bin) * 100", 6) + " END AS pct FROM f",
    "ent_c",
    "topic_table",
)
def _(t):
    return b.topics_over_rating(t.ent_c, t.topic_table).withColumn("pct", r6("pct"))


def _share(outer: str, where: str) -> str:
    return (
        f"SELECT {outer}, dominant_complaint, count(*) AS count, "
        + rnd(f"CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {outer}) * 100", 1)
        + f" AS pct FROM ent_c WHERE dominant_complaint IS NOT NULL AND {where} GROUP BY 1, 2"
    )


@register("complaints_by_city", _share("listed_city", "listed_city IN (SELECT listed_city FROM ent_c GROUP BY 1 ORDER BY count(*) DESC, listed_city LIMIT 6)"), "ent_c")
def _(t):
    return b.complaints_by_city(t.ent_c)


@register("complaints_by_rating_tier", _share("rating_tier", "rating_tier IS NOT NULL"), "ent_c")
def _(t):
    return b.complaints_by_rating_tier(t.ent_c)


# search over whole texts
_PATTERN = "ther(ou|in)"
_MATCHES = f"regexp_matches(review_text, '(?i){_PATTERN}')"
CTES["found"] = (("docs_scored",), f"SELECT *, concat('topic ', topic_id) AS topic_label FROM docs_scored WHERE {_MATCHES}")


def _searchable(t):
    return t.docs_scored.withColumn("topic_label", F.concat(F.lit("topic "), F.col("topic_id")))


@register("search_predicate", "SELECT review_id, topic_label FROM found WHERE sentiment = 'negative'", "found")
def _(t):
    return s.search_hits(_searchable(t), _PATTERN, sentiment="negative").select("review_id", "topic_label")


@register("search_index", "SELECT review_id, topic_label, sentiment FROM found", "found")
def _(t):
    found = _searchable(t)
    ensure_checkpoint_dir(found.sparkSession)
    folder = f"{found.sparkSession.sparkContext.getCheckpointDir()}/search/{uuid.uuid4().hex}"
    return build_search_index(found, folder, rows_per_file=500).hits(_PATTERN).select("review_id", "topic_label", "sentiment")


@register(
    "search_reviews",
    f"SELECT review_id, sentiment, regexp_replace(review_text, '(?i)({_PATTERN})', '<mark>\\1</mark>', 'g') AS highlighted FROM found ORDER BY review_id LIMIT 50",
    "found",
)
def _(t):
    return s.search_reviews(_searchable(t), _PATTERN, n=50).select("review_id", "sentiment", "highlighted")


@register("highlight_matches", "SELECT item_id, regexp_replace(text, '(?i)(en\\.)', '<mark>\\1</mark>', 'g') AS text FROM benchmark")
def _(t):
    return t.read("benchmark").select("item_id", fn.highlight_matches(F.col("text"), "en.").alias("text"))


@register(
    "search_stats",
    "SELECT count(*) AS results, " + rnd("avg(CASE WHEN sentiment = 'positive' THEN 1e0 ELSE 0e0 END) * 100", 6) + " AS positive_pct, "
    + rnd("avg(CASE WHEN sentiment = 'negative' THEN 1e0 ELSE 0e0 END) * 100", 6) + " AS negative_pct, count(DISTINCT topic_label) AS topics FROM found",
    "found",
)
def _(t):
    got = s.search_stats(s.search_hits(_searchable(t), _PATTERN))
    return got.withColumns({"positive_pct": r6("positive_pct"), "negative_pct": r6("negative_pct")})


@register("search_topic_breakdown", "SELECT topic_label, count(*) AS count FROM found WHERE (SELECT count(*) FROM found) >= 5 GROUP BY 1", "found")
def _(t):
    return s.search_topic_breakdown(s.search_hits(_searchable(t), _PATTERN))


