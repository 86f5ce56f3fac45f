"""Mixing sources to target weights by prefix sums over hash-random keys.

Every row has the SHA-256 of its id as a key that is random and yet the same in
every run. Rows are range-sorted by source and key, so a source of any size is
spread over tasks; each task sums the words of its rows in order, and the sums of
the tasks before it, one row per task and source, complete the prefix sum. A
source then gives whole passes over its rows as often as its budget holds them,
and one more pass up to the row where the rest of the budget is used up, which is
cut there. So every source meets its budget to the word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.llm.common import broadcast_if_small, register, table
from patronvoice.operators.cluster import dense_numbers
from patronvoice.operators.joins import lookup_join
from patronvoice.session import materialize

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix"
_WORDS = r"[^\x20\x09-\x0D]+"
_SALTS = 8  # a source may hold a third of all rows


def source_budgets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: int = EPOCHS, budget: int | None = None) -> DataFrame:
    """``sizes`` (src, source_size) with ``place``, ``weight``, ``target``, whole ``passes`` and the words ``rest`` of one more.

    Sources are placed in order of ``src`` and take the weights in turn. The
    budget (all words, if not given) is shared by weight. No target is above
    ``epochs`` times its source's size; what such sources leave is shared again by
    weight among the others until none is above. Each round is one aggregate over
    the table of sources, and a source at its limit stays there.
    """
    rows = dense_numbers(sizes, ["src"], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = materialize(rows.select("src", "source_size", "place", F.get(turn, F.pmod("place", F.lit(len(weights)))).alias("weight"), (F.col("source_size") * epochs).cast("double").alias("most")))
    total = float((rows.agg(F.sum("source_size")).first()[0] or 0) if budget is None else budget)
    full, seen = F.lit(False), -1
    while True:
        open_weight = F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        given = F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0))
        weight, used, count = rows.agg(open_weight, given, F.count(F.when(full, 1))).first()
        if count == seen or not weight:
            break
        left, seen = total - used, count
        # the level only rises, so a source above its limit is above it in all later rounds
        full = F.col("weight") * left > F.col("most") * weight
    share = F.col("weight") * F.lit(left) / F.lit(weight) if weight else F.col("most")
    target = F.when(full, F.col("most")).otherwise(share)
    whole = F.floor(target).cast("bigint")
    passes = F.coalesce(F.floor(F.try_divide(whole, F.col("source_size"))), F.lit(0)).cast("bigint")
    return rows.select("src", "source_size", "place", "weight", target.alias("target"), passes.alias("passes"), (whole - passes * F.col("source_size")).alias("rest"))


def _running(rows: DataFrame) -> DataFrame:
    """Sorted ``rows`` (place, size, ...) with ``part`` and the words ``before`` each in its source within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, held = None, 0
        for batch in batches:
            if not len(batch):
                continue
            place, size = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("place", "size"))
            ends = np.cumsum(size)
            first = np.append(True, place[1:] != place[:-1])  # rows where a source starts
            base = (ends - size)[np.flatnonzero(first)]
            base[0] -= held if place[0] == last else 0
            before = ends - size - base[np.cumsum(first) - 1]
            last, held = place[-1], int(before[-1] + size[-1])
            columns = [*batch.columns, pa.array(np.full(len(batch), part, dtype=np.int64)), pa.array(before)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "before"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("part", T.LongType()), T.StructField("before", T.LongType())]))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    epochs: int = EPOCHS,
    budget: int | None = None,
    seed: str = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(id, source, size, source_size, target, passes, rest, taken, carried) of every row.

    ``size`` is the number of words (runs of anything but ASCII white space), 0 for
    a null text. ``passes`` whole copies of the row and the first ``rest`` words
    of it are in the mix, ``taken`` words in all; the words taken from a source
    are its target rounded down. A null source is a source of its own, placed
    last; one without words has the target 0. Rows with equal ids follow each
    other by size and text; a null id counts as the text's SHA-256. Rows equal in
    both id and text are alike and may take each other's place. An empty table
    gives no row. Only the named columns are looked at; those of ``carry`` travel
    along, in the struct ``carried``, and texts do so only if named there.
    """
    text = F.col(text_col)
    words = F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("bigint")
    name = F.coalesce(F.col(id_col).cast("string"), F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1")).alias("src"),  # null sorts last
        words.alias("size"),
        F.unhex(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)).alias("key"),
        F.xxhash64(text).alias("tie"),
        F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(True).alias("row")]).alias("carried"),
    )
    rows = materialize(rows)
    sources = materialize(source_budgets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), weights, epochs, budget))
    count = sources.count()

    placed = lookup_join(rows, broadcast_if_small(sources.select("src", "place"), count * _SALTS, 128), ["src"], _SALTS)
    ordered = placed.select("place", "key", "size", "tie", "id", "carried").orderBy("place", "key", "size", "tie")
    running = materialize(_running(ordered.drop("key", "tie")))
    parts = running.groupBy("place", "part").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.select("place", "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead")))
    # one row per task and source that it holds rows of
    bounds = broadcast_if_small(lookup_join(parts, sources, ["place"]), parts.count(), 256)
    whole = lookup_join(running, bounds, ["place", "part"])
    rest = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead") - F.col("before"))).cast("bigint")
    return whole.select(
        F.col("id").alias(id_col),
        F.when(F.col("src") != "1", F.substring("src", 2, 1 << 30)).alias("source"),
        "size",
        "source_size",
        "target",
        "passes",
        rest.alias("rest"),
        (F.col("passes") * F.col("size") + rest).alias("taken"),
        "carried",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the columns of ``docs`` and ``epoch``, one row per pass over a row, in hash-random order within a source.

    The row in which a source's budget ends has the words that are left, joined by
    one space; every other row has its whole text. A column ``epoch`` is replaced.
    Rows without words are in the whole passes.
    """
    names = [c for c in docs.columns if c.lower() != "epoch"]
    found = mix_sources(docs, id_col, text_col, source_col, carry=names, **options)
    epochs = F.sequence(F.lit(0).cast("bigint"), F.col("passes") + F.when(F.col("rest") > 0, 0).otherwise(-1))
    some = found.where((F.col("passes") > 0) | (F.col("rest") > 0)).select("passes", "rest", "size", "carried", F.explode(epochs).alias("epoch"))
    cut = (F.col("epoch") == F.col("passes")) & (F.col("rest") < F.col("size"))
    text = F.col(f"carried.`{text_col}`")
    start = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(_WORDS), 0), F.lit(1), F.col("rest").cast("int")), " ")
    return some.select(*[F.when(cut, start).otherwise(text).alias(c) if c == text_col else F.col(f"carried.`{c}`") for c in names], "epoch")


_SQL = rf"""
WITH r AS (SELECT doc_id, source, sha256('{SEED}:' || doc_id) AS k, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS p FROM r GROUP BY source),
w AS (SELECT *, CASE p % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, source_size * 3e0 AS most, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0) AS open_weight, total - coalesce(sum(most) OVER prior, 0) AS remaining FROM w
  WINDOW prior AS (ORDER BY most / weight, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, weight * remaining > most * open_weight AS at_limit FROM o),
g AS (SELECT *, total - coalesce(sum(most) FILTER (at_limit) OVER (), 0) AS rest, sum(weight) FILTER (NOT at_limit) OVER () AS rest_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN at_limit THEN most ELSE weight * rest / rest_weight END AS target FROM g),
b AS (SELECT r.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM b)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size + greatest(0, least(size, budget - passes * source_size - ahead)) AS BIGINT) AS taken FROM e
"""


@register("op11_prefix_sum_mix", _SQL)
def op11(spark, folder):
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
