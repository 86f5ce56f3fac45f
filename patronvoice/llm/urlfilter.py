"""URL filter: written rules first, else association rules mined from labelled URLs.

A URL is the set of its host and path tokens. FP-growth over the labelled URLs
finds the token combinations that go with blocked documents; combinations with
enough support and confidence, and with more blocks than chance would give them,
become rules. They are matched through an
inverted index: each rule is filed under its rarest token, so that a URL only
meets rules that share this token with it, and then must contain all the others.
All of it runs in Spark's own functions and its FP-growth.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import broadcast_if_small, lower_ascii, register, table
from patronvoice.session import materialize

ALLOW, BLOCK = "allow", "block"
#: written rules (host and path, verdict) of the query
RULES = (
    ("com/", ALLOW),
    ("example.com/en/", BLOCK),
    ("www.example.com/en/", ALLOW),
    ("net/es/", BLOCK),
    ("net/fr/", BLOCK),
)
#: A mined rule's combination occurs with a block in so many labelled URLs at least, whatever their number; among the
#: URLs with the combination this share is blocked, which lies so many standard deviations above the share in all.
MIN_COUNT, MIN_CONFIDENCE, MIN_DEVIATIONS = 20, 0.6, 4.0
_TARGET = "=block"
_ROW_BYTES = 600  # of one rule in the index


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: parts of the host, and parts of the path that are not numbers."""
    hosts = F.transform(F.filter(F.split(host, r"[.\-]+"), lambda t: t != ""), lambda t: F.concat(F.lit("h="), t))
    parts = F.filter(F.split(lower_ascii(path), r"[/._\-]+"), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))
    return F.array_distinct(F.concat(hosts, F.transform(parts, lambda t: F.concat(F.lit("p="), t))))


def written_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule fits its host and the subdomains of it when the path starts with the
    rule's path. Rules are a short written list, tried from the longest on.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def mine_rules(
    labelled: DataFrame,
    tokens_col: str = "tokens",
    blocked_col: str = "blocked",
    min_count: int = MIN_COUNT,
    min_confidence: float = MIN_CONFIDENCE,
    min_deviations: float = MIN_DEVIATIONS,
) -> DataFrame:
    """(tokens, confidence, support, lift) of the combinations that go with a block.

    Of n URLs with a combination, a share p of all being blocked, chance blocks
    np with a standard deviation of sqrt(np(1 - p)). Rows with null tokens or a
    null label are left out. Fewer than ``min_count`` blocked rows give no rule,
    and neither do labels that all say the same.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(tokens_col).isNotNull() & F.col(blocked_col).isNotNull())
    items = rows.select(
        F.when(F.col(blocked_col), F.array_append(F.col(tokens_col), F.lit(_TARGET))).otherwise(F.col(tokens_col)).alias("items")
    )
    items = materialize(items)
    n, blocked = items.agg(F.count(F.lit(1)), F.count_if(F.array_contains("items", _TARGET))).first()
    if blocked < max(min_count, 1):
        return spark.createDataFrame([], "tokens array<string>, confidence double, support double, lift double")
    # a hair less, so that exactly min_count rows are enough whatever the division gives
    model = FPGrowth(itemsCol="items", minSupport=min_count / n * (1 - 1e-9), minConfidence=min_confidence).fit(items)
    base = blocked / n
    having = F.round(F.col("support") * n / F.col("confidence"))  # URLs with the combination
    above = (F.col("confidence") - base) * F.sqrt(having) >= min_deviations * math.sqrt(base * (1 - base))
    rules = model.associationRules.where(F.element_at("consequent", 1) == _TARGET)
    found = rules.where((F.col("confidence") > base) & above)
    return found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support", "lift")


def rule_index(rules: DataFrame, labelled: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """The rules with the token they are filed under: their rarest one among the labelled URLs."""
    often = labelled.select(F.explode(tokens_col).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select("tokens", "confidence", F.explode("tokens").alias("token"))
    rarest = F.min_by(F.col("token"), F.struct("n", "token"))
    return each.join(often, "token").groupBy("tokens", "confidence").agg(rarest.alias("token"))


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    **limits: float,
) -> DataFrame:
    """(id, host, path, rule, verdict, confidence) for every row of ``pages``.

    ``labelled`` has ``tokens`` and ``blocked``. The verdict is the written rule's;
    without one, block if a mined rule matches (``confidence`` is the best one's),
    else allow. A null URL or one without ``://`` has empty host and path and is
    allowed. Repeated rows give one row each; only the two named columns of
    ``pages`` are looked at.
    """
    labelled = materialize(labelled.select("tokens", "blocked"))
    index = materialize(rule_index(mine_rules(labelled, **limits), labelled))
    n = index.count()
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("page_tokens", url_tokens(F.col("host"), F.col("path")))
    met = rows.select("*", F.explode_outer("page_tokens").alias("token")).join(broadcast_if_small(index, n, _ROW_BYTES), "token", "left")
    matched = F.when(F.forall("tokens", lambda t: F.array_contains("page_tokens", t)), F.col("confidence"))
    best = met.groupBy("row", "id", "host", "path").agg(F.max(matched).alias("confidence"))
    rule, verdict = written_rule(F.col("host"), F.col("path"), rules)
    mined = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return best.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence"
    )


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, blocked) of the pages whose document is labelled.

    A page's path names its document by number behind the language; a document of
    low quality or a toxic one blocks.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    pages = pages.select(
        url_tokens(host, path).alias("tokens"), F.regexp_extract(path, "^/[a-z]+/([0-9]{1,18})(?![0-9])", 1).try_cast("bigint").alias("doc_id")
    ).where("doc_id IS NOT NULL")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked"))
    return pages.join(marks, "doc_id").select("tokens", "blocked")


_SQL_HOST = "translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = "regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_SQL_LOWER_PATH = "translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_FITS = " ".join(
    f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
    for r, _ in sorted(RULES, key=lambda r: (len(r[0]), r[0]), reverse=True)
)
_SQL_VERDICT = " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES)
OP5_SQL = rf"""
WITH p AS (SELECT page_id, coalesce({_SQL_HOST}, '') AS host, coalesce({_SQL_PATH}, '') AS path FROM pages),
t AS (
  SELECT *, list_sort(list_distinct(
    list_transform(list_filter(regexp_split_to_array(host, '[.-]+'), lambda x: x <> ''), lambda x: 'h=' || x) ||
    list_transform(list_filter(regexp_split_to_array({_SQL_LOWER_PATH}, '[/._-]+'), lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+')), lambda x: 'p=' || x))) AS tokens
  FROM p),
s AS (
  SELECT page_id, path, array_to_string(list_filter(tokens, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS part
  FROM (SELECT page_id, path, tokens, unnest(range(1, 1 << len(tokens))) AS mask FROM t)),
l AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS blocked FROM labels GROUP BY doc_id),
x AS (SELECT s.part, s.page_id, l.blocked FROM s JOIN l ON l.doc_id = TRY_CAST(regexp_extract(s.path, '^/[a-z]+/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) WHERE l.blocked IS NOT NULL),
n AS (SELECT avg(CAST(blocked AS INT)) AS base FROM t JOIN l ON l.doc_id = TRY_CAST(regexp_extract(t.path, '^/[a-z]+/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) WHERE l.blocked IS NOT NULL),
r AS (
  SELECT part FROM x, n GROUP BY part, n.base
  HAVING sum(CAST(blocked AS INT)) >= {MIN_COUNT} AND avg(CAST(blocked AS INT)) >= {MIN_CONFIDENCE} AND avg(CAST(blocked AS INT)) > n.base
    AND (avg(CAST(blocked AS INT)) - n.base) * sqrt(count(*)) >= {MIN_DEVIATIONS} * sqrt(n.base * (1 - n.base))),
m AS (SELECT DISTINCT s.page_id FROM s JOIN r ON s.part = r.part),
j AS (SELECT page_id, host, path, CASE {_SQL_FITS} END AS rule FROM p)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(CASE j.rule {_SQL_VERDICT} END, CASE WHEN m.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM j LEFT JOIN m ON j.page_id = m.page_id
"""


@register("op5_url_association_rules", OP5_SQL)
def op5(spark, folder):
    pages = table(spark, folder, "pages")
    judged = judge_urls(pages, labelled_pages(pages, table(spark, folder, "labels")))
    return judged.drop("confidence")
