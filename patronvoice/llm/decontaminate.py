"""Benchmark decontamination: word windows of test items found in training documents.

All windows of the benchmark form a hash table, broadcast when its measured size
allows; each document's windows are hashed and looked up in it, and a hit counts
only if the words agree. Everything runs in DataFrame functions. A document's
hits are gathered per row of the input, so that a group is never longer than its
document, and a passage that many documents share is just many single hits. A
table too large for that is joined with the codes of the windows of each distinct
text: no words travel with a window, and the hits of a text meet its words once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import BROADCAST_BYTES, lower_ascii, register, table
from patronvoice.operators.joins import lookup_join
from patronvoice.session import materialize

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PIECE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROW_BYTES = 120  # of one window in the hash table beside its texts: code, length, array, the table's own needs
_SALTS = 32  # over which the rows of a passage or of a text that many documents share are spread
_MARKS = 256  # marks that carry documents without hits through the lookup, spread over as many keys


def words_of(text: Column) -> Column:
    """The lower-cased words of a text; null has none."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _windows(codes: Column, words: Column, length: int, short: bool) -> Column:
    """(at, length, code) of all windows; with ``short`` the whole text where it has ``length`` words."""
    last = F.size(words) - length + 1
    places = F.sequence(F.lit(1), last)
    some = last == 1 if short else last >= 1
    found = F.transform(
        F.when(some, places).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.alias("at"), F.lit(length).alias("length"), F.xxhash64(F.slice(codes, i, length)).alias("code")),
    )
    return found


def _codes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _text(words: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, at, length), " ")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(code, win, length, items) of the distinct windows of all items."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("codes", _codes(F.col("words")))
    parts = [_windows(F.col("codes"), F.col("words"), n, short=n < window) for n in range(1, window + 1)]
    found = items.select("item", "words", F.explode(F.concat(*parts)).alias("w"))
    found = found.select("item", "w.code", "w.length", _text(F.col("words"), F.col("w.at"), F.col("w.length")).alias("win"))
    return found.groupBy("code", "length", "win").agg(F.collect_set("item").alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per row of ``docs``: id, text_sha256, n_words, spans of hit words, items found.

    A window is ``window`` consecutive words of an item, or all words of an item
    that has fewer. ``spans`` are (first word from 1, length), sorted; ``items``
    are sorted as strings. Null texts have no words and no hits; a null item id
    counts as the empty string, repeated item ids as one item; repeated rows of
    ``docs`` give one row each; an empty benchmark hits nothing. Very long texts
    are looked up whole. Only the named columns are looked at.
    """
    known = materialize(benchmark_windows(benchmark, item_col, item_text_col, window))
    held = F.octet_length("win") + F.aggregate("items", F.lit(0), lambda n, i: n + F.octet_length(i) + 16) + _ROW_BYTES
    # at most ``window`` lengths come back
    sizes = known.groupBy("length").agg(F.sum(held.cast("bigint")).alias("bytes")).collect()
    lengths = sorted(r["length"] for r in sizes)
    find = _by_broadcast if sum(r["bytes"] for r in sizes) <= BROADCAST_BYTES else _by_exchange
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("text_sha256"))
    return find(rows, known, lengths).select(F.col("id").alias(id_col), "text_sha256", "n_words", "spans", "items")


def _by_broadcast(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, text_sha256, n_words, spans, items) of each row, its windows looked up where they are."""
    marks = docs.sparkSession.range(_MARKS).select(
        F.xxhash64(F.lit("mark"), "id").alias("code"),
        F.lit(0).alias("length"),
        F.lit("").alias("win"),
        F.array().cast("array<string>").alias("items"),
    )
    rows = docs.select(
        "id", F.monotonically_increasing_id().alias("row"), "text_sha256", words_of(F.col("text")).alias("words")
    ).withColumn("codes", _codes(F.col("words")))
    mark = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("length"), F.xxhash64(F.lit("mark"), F.pmod("row", F.lit(_MARKS))).alias("code")
    )
    parts = [_windows(F.col("codes"), F.col("words"), n, short=False) for n in lengths]
    looked = rows.select(
        "id", "row", "text_sha256", "words", F.size("words").cast("bigint").alias("n_words"), F.explode(F.concat(F.array(mark), *parts)).alias("w")
    ).select("*", F.col("w.code").alias("code"), F.col("w.length").alias("length"))
    hits = looked.join(F.broadcast(known.unionByName(marks)), ["code", "length"]).where(
        (F.col("length") == 0) | (_text(F.col("words"), F.col("w.at"), F.col("length")) == F.col("win"))
    )
    span = F.when(F.col("length") > 0, F.struct(F.col("w.at").alias("at"), F.col("length").alias("length")))
    return (
        hits.select("id", "row", "text_sha256", "n_words", span.alias("span"), "items")
        .groupBy("row", "id", "text_sha256", "n_words")
        .agg(
            F.sort_array(F.collect_set("span")).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )


def _by_exchange(docs: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """The same through joins on codes; what a row gets depends on its text alone, so each text is looked up once.

    A known window travels as its code until a text is known to hold that code;
    then the windows and the words of a text meet in one row, no longer than the
    text and its hits, and are compared.
    """
    worded = docs.where(F.col("text").isNotNull()).groupBy("text_sha256").agg(words_of(F.first("text")).alias("words"))
    texts = materialize(worded.where(F.size("words") > 0))
    codes = texts.withColumn("codes", _codes(F.col("words")))
    parts = [_windows(F.col("codes"), F.col("words"), n, short=False) for n in lengths]
    looked = codes.select("text_sha256", F.explode(F.concat(*parts)).alias("w")).select("text_sha256", "w.*")
    # several windows of one code are one row, so that the join stays a lookup
    by_code = known.groupBy("code", "length").agg(F.collect_list(F.struct("win", "items")).alias("wins"))
    met = lookup_join(looked, by_code, ["code", "length"], _SALTS).where(F.col("wins").isNotNull())
    met = met.groupBy("text_sha256").agg(F.collect_list(F.struct("at", "length", "wins")).alias("met"))
    both = texts.join(met, "text_sha256", "left")
    same = lambda m: F.filter(m["wins"], lambda w: w["win"] == _text(F.col("words"), m["at"], m["length"]))
    true = F.filter(
        F.transform(
            F.coalesce("met", F.array().cast(met.schema["met"].dataType)),
            lambda m: F.struct(m["at"].alias("at"), m["length"].alias("length"), same(m).alias("wins")),
        ),
        lambda m: F.size(m["wins"]) > 0,
    )
    found = both.select("text_sha256", F.size("words").cast("bigint").alias("n_words"), true.alias("true"))
    items = F.flatten(F.transform("true", lambda m: F.flatten(F.transform(m["wins"], lambda w: w["items"]))))
    spans = F.transform("true", lambda m: F.struct(m["at"].alias("at"), m["length"].alias("length")))
    found = found.select(
        "text_sha256",
        "n_words",
        F.sort_array(F.array_distinct(spans)).alias("spans"),
        F.sort_array(F.array_distinct(items)).alias("items"),
    )
    types = found.schema
    joined = lookup_join(docs.select("id", "text_sha256"), found, ["text_sha256"], _SALTS)
    return joined.select(
        "id",
        "text_sha256",
        F.coalesce("n_words", F.lit(0).cast("bigint")).alias("n_words"),
        *[F.coalesce(c, F.array().cast(types[c].dataType)).alias(c) for c in ("spans", "items")],
    )


def covered_words(spans: Column) -> Column:
    """How many words sorted spans cover, overlaps once."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(seen: Column, span: Column) -> Column:
        end = span["at"] + span["length"]
        fresh = F.greatest(end - F.greatest(seen["end"], span["at"]), F.lit(0))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step, lambda seen: seen["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **columns: str) -> DataFrame:
    """``docs`` without its contaminated rows, or (``remove="spans"``) without the hit words in them.

    What a row loses depends on its text alone, so rows are matched by the digest
    of the text; null texts stay. With ``spans`` the text between words stays too.
    """
    found = contamination(docs, benchmark, text_col=text_col, **columns).where(F.size("spans") > 0)
    found = found.groupBy("text_sha256").agg(F.first("spans").alias("spans"))
    digest = F.sha2(F.col(text_col), 256) == F.col("_found.text_sha256")
    if remove == "documents":
        return docs.join(found.select("text_sha256").alias("_found"), digest, "left_anti")
    if remove != "spans":
        raise ValueError(remove)
    joined = docs.join(found.alias("_found"), digest, "left")
    text = F.when(F.col("_found.spans").isNull(), F.col(text_col)).otherwise(_without(F.col(text_col), F.col("_found.spans")))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])


def _without(text: Column, spans: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    hit = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    is_word = "^" + _PIECE.partition("|")[0]
    # words and what lies between them alternate
    first = F.when(F.element_at(pieces, 1).rlike(is_word), 1).otherwise(0)
    number = lambda i: F.floor((i + 1 + first) / 2).cast("int")
    kept = F.filter(pieces, lambda p, i: ~((F.pmod(i + 1 + first, F.lit(2)) == 0) & F.array_contains(hit, number(i))))
    return F.array_join(kept, "")


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP6_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(words), {WINDOW}) AS k,
    unnest(list_transform(range(1, len(words) - least(len(words), {WINDOW}) + 2), lambda i: array_to_string(words[i:i + least(len(words), {WINDOW}) - 1], ' '))) AS win
  FROM b WHERE len(words) > 0),
d AS (SELECT doc_id, {_SQL_WORDS} AS words FROM documents),
dk AS (SELECT doc_id, words, k FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k),
dp AS (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM dk),
dw AS (SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS win FROM dp),
hits AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(w.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(m.items, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words w ON d.doc_id = w.doc_id LEFT JOIN hit_items m ON d.doc_id = m.doc_id
"""


@register("op6_ngram_decontamination", OP6_SQL)
def op6(spark, folder):
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    hit = covered_words(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
