"""Base tables derived from the driver tables by the same SQL text in both engines."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronvoice.functions import bin_rating_tier, round_half_even
from patronvoice.operators.sentiment import add_sentiment
from patronvoice.operators.topics import map_topics_to_entities
from patronvoice.plans.sentiment import entities_with_sentiment
from patronvoice.sources.fixed import DEMO_TOPICS
from patronvoice.sources.readers import spread_small_input

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

Q, BS, NL = "chr(39)", "chr(92)", "chr(10)"
_PK = "CAST(p_partkey AS STRING)"
_VOTES = "((p_partkey * 37) % 5000)"
_COST = "CAST(100 + (p_partkey * 53) % 1900 AS STRING)"

# messy listings, one per part
RAW = {
    "url": f"CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 10 = 9 THEN concat('place/', CAST(p_partkey - 1 AS STRING)) ELSE concat('place/', {_PK}) END",
    "address": "concat('  ', p_name, ' street ', CAST(p_size AS STRING), ' ')",
    "name": f"CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat(' ', p_name, {Q}, 's   bbq-house ', {_PK}, 'th') END",
    "online_order": "CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no ' WHEN 2 THEN NULL WHEN 3 THEN 'maybe' ELSE ' YES' END",
    "book_table": "CASE p_partkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' ELSE NULL END",
    "rate": "CASE WHEN p_partkey % 17 = 0 THEN 'NEW' WHEN p_partkey % 19 = 0 THEN '-' WHEN p_partkey % 23 = 0 THEN NULL "
    "ELSE concat(CAST(1 + p_size % 5 AS STRING), '.', CAST(p_partkey % 10 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '/5' ELSE ' /5' END) END",
    "votes": f"CASE WHEN p_partkey % 29 = 0 THEN NULL WHEN p_partkey % 31 = 0 THEN 'abc' WHEN p_partkey % 41 = 0 THEN '-3' "
    f"WHEN p_partkey % 97 = 1 THEN '50,000' WHEN {_VOTES} >= 1000 THEN concat(substring(CAST({_VOTES} AS STRING), 1, 1), ',', substring(CAST({_VOTES} AS STRING), 2, 3)) "
    f"ELSE CAST({_VOTES} AS STRING) END",
    "phone": f"CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('080 ', {_PK}) END",
    "location": "concat('  ', lower(p_type), '   road ')",
    "rest_type": "CASE WHEN p_partkey % 43 = 0 THEN NULL WHEN p_partkey % 47 = 0 THEN 'ghost kitchen' ELSE concat(lower(p_type), ' ', CAST(p_size % 3 AS STRING)) END",
    "dish_liked": "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END",
    "cuisines": "CASE WHEN p_partkey % 53 = 0 THEN NULL ELSE concat(p_brand, ' ,Chinese') END",
    "approx_cost(for two people)": f"CASE WHEN p_partkey % 47 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 59 = 0 THEN '0' "
    f"WHEN p_partkey % 101 = 1 THEN '9,999' WHEN p_partkey % 3 = 0 THEN concat('₹', {_COST}) ELSE {_COST} END",
    "reviews_list": f"CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '[broken' WHEN p_partkey % 7 = 0 THEN '[]' ELSE "
    f"concat('[(', {Q}, 'Rated ', CAST(1 + p_size % 5 AS STRING), '.0', {Q}, ', ', {Q}, 'RATED', {BS}, 'n  Great food ', p_name, {Q}, '), (', "
    f"{Q}, 'Rated 3.0', {Q}, ', ', {Q}, 'Average', {BS}, {BS}, 'nplace', {Q}, '), (', {Q}, 'Rated 1.0', {Q}, ', ', {Q}, ' nan ', {Q}, ')]') END",
    "menu_item": "CAST(NULL AS STRING)",
    "listed_in(type)": "concat(' ', lower(p_type))",
    "listed_in(city)": "concat(upper(p_brand), '  east')",
}
# what parsing reviews_list has to give
TEXT_1 = f"concat('RATED', {NL}, '  Great food ', p_name)"
TEXT_2 = "'Average place'"
HAS_TEXTS = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 AND p_partkey % 7 <> 0"

# clean listings with numbers, one per part
ENTITIES = {
    "url": "p_partkey",
    "name": "p_name",
    "rest_type": "p_type",
    "listed_city": "p_brand",
    "online_order": "CASE WHEN p_partkey % 3 = 0 THEN 'No' ELSE 'Yes' END",
    "rate": "CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(10 + (p_partkey * 7) % 41 AS DOUBLE) / 10e0 END",
    "approx_cost": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END",
}

# one review per line; every twentieth part has none, its lines count for its neighbour
LINES = {
    "url": "CASE WHEN l_partkey % 20 = 7 THEN l_partkey - 1 ELSE l_partkey END",
    "raw_label": "CASE WHEN (l_partkey % 3 = 0 AND l_linenumber < 6) OR l_linenumber = 7 THEN 'NEGATIVE' ELSE 'POSITIVE' END",
    "score": "CAST(60 + CAST(l_quantity AS INT) % 40 AS DOUBLE) / 100e0",
    "topic_id": "CAST((l_suppkey + l_partkey * l_linenumber) % 9 - 1 AS BIGINT)",
}

# one review per document
DOCS = {
    "review_id": "d.doc_id",
    "url": "concat(lang, '/', source)",
    "name": "source",
    "lang": "lang",
    "review_text": "text",
    "raw_label": "CASE WHEN quality = 1 AND toxic = 0 THEN 'POSITIVE' WHEN quality IS NULL AND d.doc_id % 3 = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END",
    "score": "CAST(60 + d.doc_id % 40 AS DOUBLE) / 100e0",
    "topic_id": "CAST(d.doc_id % 9 - 1 AS BIGINT)",
}

# every line of a document is a review of that document
LINE_LABEL = "CASE WHEN length(review_text) % 3 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END"
LINE_SCORE = "CAST(60 + length(review_text) % 40 AS DOUBLE) / 100e0"
SPACES = "\\t-\\r\\x1c-\\x1f \\x{85}\\p{Z}"  # inside a character class

LABEL_OF_TOPIC = (
    "CASE topic_id WHEN -1 THEN 'Uncategorised / noise' "
    + " ".join(f"WHEN {i} THEN '{t[0]}'" for i, t in enumerate(DEMO_TOPICS))
    + " END"
)


def _list(columns: dict[str, str], quote: str) -> str:
    return ", ".join(f"{expr} AS {quote}{name}{quote}" for name, expr in columns.items())


def rnd(expr: str, digits: int) -> str:
    """Half-even rounding in the oracle's dialect."""
    scale = f"1{'0' * digits}e0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def r6(c: Column | str) -> Column:
    return round_half_even(F.col(c) if isinstance(c, str) else c, 6)


SENTIMENT = "CASE WHEN score < 0.75e0 THEN 'neutral' WHEN raw_label = 'POSITIVE' THEN 'positive' ELSE 'negative' END"
SIGNED = "CASE sentiment WHEN 'positive' THEN score WHEN 'negative' THEN -score ELSE 0e0 END"


def _scored(source: str) -> str:
    return f"SELECT *, {SIGNED} AS signed_score FROM (SELECT *, {SENTIMENT} AS sentiment FROM {source})"


def _aggregate(source: str) -> str:
    pct = ", ".join(
        f"{rnd(f'CAST({c}_count AS DOUBLE) / total_reviews * 100', 1)} AS sentiment_{c}_pct"
        for c in ("positive", "negative", "neutral")
    )
    return (
        f"SELECT *, {pct}, CASE WHEN positive_count >= negative_count AND positive_count >= neutral_count THEN 'positive' "
        "WHEN negative_count >= neutral_count THEN 'negative' ELSE 'neutral' END AS dominant_sentiment FROM ("
        "SELECT url, count(*) AS total_reviews, count(*) FILTER (sentiment = 'positive') AS positive_count, "
        "count(*) FILTER (sentiment = 'negative') AS negative_count, count(*) FILTER (sentiment = 'neutral') AS neutral_count, "
        f"{rnd('avg(signed_score)', 4)} AS avg_signed_score, coalesce(stddev_samp(signed_score), 0e0) AS sentiment_volatility "
        f"FROM {source} GROUP BY url)"
    )


_ZEROS = ", ".join(
    [f"coalesce(a.{c}, 0) AS {c}" for c in ("total_reviews", "positive_count", "negative_count", "neutral_count")]
    + [f"coalesce(a.{c}, 0e0) AS {c}" for c in ("avg_signed_score", "sentiment_volatility", "sentiment_positive_pct", "sentiment_negative_pct", "sentiment_neutral_pct")]
    + ["coalesce(a.dominant_sentiment, 'neutral') AS dominant_sentiment"]
)
_TIER = "CASE WHEN rate <= 3 THEN 'low' WHEN rate <= 3.5 THEN 'average' WHEN rate <= 4 THEN 'good' WHEN rate <= 5 THEN 'excellent' END"

# name -> (CTEs it builds on, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), f"SELECT {_list(RAW, chr(34))} FROM part"),
    "ent": ((), f"SELECT {_list(ENTITIES, '')} FROM part"),
    "lines": ((), f"SELECT {_list(LINES, '')} FROM lineitem"),
    "docs": ((), f"SELECT {_list(DOCS, '')} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "doc_lines": (
        (),
        "SELECT source AS name, doc_id AS url, CAST(i - 1 AS INT) AS review_pos, l[i] AS review_text FROM "
        "(SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)) "
        f"WHERE NOT regexp_full_match(l[i], '[{SPACES}]*')",
    ),
    "lines_scored": (("lines",), _scored("lines")),
    "docs_scored": (("docs",), _scored("docs")),
    "agg": (("lines_scored",), _aggregate("lines_scored")),
    "docs_agg": (("docs_scored",), _aggregate("docs_scored")),
    "ent_s": (("ent", "agg"), f"SELECT e.*, {_ZEROS}, coalesce(a.total_reviews, 0) AS review_count, {_TIER} AS rating_tier FROM ent e LEFT JOIN agg a ON e.url = a.url"),
    "lines_topics": (("lines",), f"SELECT *, {LABEL_OF_TOPIC} AS topic_label FROM lines"),
    "complaint_counts": (("lines_topics",), "SELECT url, topic_label, count(*) AS n FROM lines_topics WHERE topic_id <> -1 GROUP BY ALL"),
    "complaints": (
        ("complaint_counts",),
        "SELECT url, count(*)::INT AS complaint_diversity, sum(n)::INT AS complaint_review_count, "
        "string_agg(concat(topic_label, '=', n), ';' ORDER BY topic_label) AS complaint_topic_counts, "
        "first(topic_label ORDER BY n DESC, topic_label) AS dominant_complaint FROM complaint_counts GROUP BY url",
    ),
    "ent_c": (
        ("ent_s", "complaints"),
        "SELECT e.*, c.dominant_complaint, coalesce(c.complaint_diversity, 0) AS complaint_diversity, "
        "coalesce(c.complaint_review_count, 0) AS complaint_review_count, c.complaint_topic_counts "
        "FROM ent_s e LEFT JOIN complaints c ON e.url = c.url",
    ),
    "topic_table": (
        ("lines_topics",),
        f"SELECT topic_id, topic_label, count(*) AS frequency, {rnd('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM lines_topics) * 100', 2)} AS pct "
        "FROM lines_topics GROUP BY ALL",
    ),
}


def with_ctes(sql: str, *names: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in CTES[name][0]:
                need(other)
            order.append(name)

    for name in names:
        need(name)
    tail = ", " + sql[len("WITH ") :] if sql.startswith("WITH ") else " " + sql
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + tail


class Tables:
    """The same base tables as DataFrames, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def part(self) -> DataFrame:
        return self.read("part")

    @cached_property
    def documents(self) -> DataFrame:
        return spread_small_input(self.read("documents"), "doc_id")

    @cached_property
    def raw(self) -> DataFrame:
        return self.part.selectExpr(*[f"{e} AS `{n}`" for n, e in RAW.items()])

    @cached_property
    def ent(self) -> DataFrame:
        return self.part.selectExpr(*[f"{e} AS {n}" for n, e in ENTITIES.items()])

    @cached_property
    def lines(self) -> DataFrame:
        return self.read("lineitem").selectExpr(*[f"{e} AS {n}" for n, e in LINES.items()])

    @cached_property
    def docs(self) -> DataFrame:
        joined = self.documents.alias("d").join(self.read("labels").alias("l"), F.expr("d.doc_id = l.doc_id"), "left")
        return joined.selectExpr(*[f"{e} AS {n}" for n, e in DOCS.items()])

    @cached_property
    def nested(self) -> DataFrame:
        """Documents as entities whose reviews are their lines."""
        return self.documents.select(
            F.col("doc_id").alias("url"), F.col("source").alias("name"), F.split("text", "\n").alias("review_texts")
        )

    @cached_property
    def lines_scored(self) -> DataFrame:
        return add_sentiment(self.lines)

    @cached_property
    def docs_scored(self) -> DataFrame:
        return add_sentiment(self.docs)

    @cached_property
    def ent_s(self) -> DataFrame:
        return (
            entities_with_sentiment(self.ent, self.lines_scored)
            .withColumn("review_count", F.col("total_reviews"))
            .withColumn("rating_tier", bin_rating_tier(F.col("rate")))
        )

    @cached_property
    def lines_topics(self) -> DataFrame:
        return self.lines.withColumn("topic_label", F.expr(LABEL_OF_TOPIC))

    @cached_property
    def ent_c(self) -> DataFrame:
        return map_topics_to_entities(self.ent_s, self.lines_topics)

    @cached_property
    def topic_table(self) -> DataFrame:
        counts = self.lines_topics.groupBy("topic_id", "topic_label").agg(F.count(F.lit(1)).alias("frequency"))
        total = counts.agg(F.sum("frequency")).scalar()
        return counts.withColumn("pct", round_half_even(F.col("frequency") / total * 100, 2))


def register(name: str, sql: str | None = None, *ctes: str):
    """Register a query on the base tables and, where there is one, its SQL."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def wrap(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *ctes) if ctes else sql
        return build

    return wrap
