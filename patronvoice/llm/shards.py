"""Shards of near-equal bytes by histogram sort.

Rows are ordered by the hash of their text and then by a hash of the whole row,
so that copies of a text lie together and a group of any size can be cut.
Candidate boundaries are probed by counting exactly, in partial sums over the
partitions, the bytes below each; the interval of every splitter shrinks around
its target until the bytes meet the tolerance. Then rows are exchanged once, by
block: a shard is a run of blocks, and a block's rows are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import hash_of, other_columns, register, table
from patronvoice.session import materialize

SHARDS = 16
#: Largest distance of a splitter from its target, as a share of a block's bytes.
TOLERANCE = 0.002
#: Bytes of a block, about; a shard has 1 to MAX_BLOCKS of them.
BLOCK_BYTES, MAX_BLOCKS = 16 << 20, 256
_PROBES = 16
_HALF = 1 << 63


def _join(high: int, low: int) -> int:
    return (high + _HALF) << 64 | (low + _HALF)


def _part(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & (1 << 64) - 1) - _HALF


def _block_of(keys: Sequence[int]):
    """A function from key columns to the number of sorted keys that are not above them."""
    high = np.array([_part(k)[0] for k in keys], dtype=np.int64)
    low = np.array([_part(k)[1] for k in keys], dtype=np.int64)

    def run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        left, right = np.searchsorted(high, a, side="left"), np.searchsorted(high, a, side="right")
        for k in np.flatnonzero(left < right) if len(high) and (left < right).any() else ():
            right[k] = left[k] + np.searchsorted(low[left[k] : right[k]], b[k], side="right")
        return right

    return run


def _histogram(keyed: DataFrame, keys: Sequence[int]) -> list[tuple[int, int]]:
    """(bytes, rows) between consecutive keys, exactly; one row per interval reaches the driver."""
    place = _block_of(keys)
    n = len(keys) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for batch in batches:
            high, low, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            block = place(high, low)
            np.add.at(size, block, own)
            rows += np.bincount(block, minlength=n)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], names=["block", "size", "rows"])

    parts = keyed.select("high", "low", "size").mapInArrow(partial, "block bigint, size bigint, rows bigint")
    out = [(0, 0)] * n
    for r in parts.groupBy("block").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect():
        out[r["block"]] = (r["size"], r["rows"])
    return out


def find_splitters(keyed: DataFrame, blocks: int, tolerance: float = TOLERANCE) -> list[int]:
    """Keys that cut the rows (``high``, ``low``, ``size``) into blocks of near-equal bytes.

    A splitter is as near to its target as the rows allow, or within the tolerance.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    targets = [total * (k + 1) / blocks for k in range(blocks - 1)]
    slack = tolerance * total / blocks
    low, high = [0] * len(targets), [1 << 128] * len(targets)  # bytes below low <= target <= bytes below high
    below = {0: 0, 1 << 128: total}
    while True:
        probes: set[int] = set()
        for lo, hi, goal in zip(low, high, targets):
            if hi - lo > 1 and min(goal - below[lo], below[hi] - goal) > slack:
                step = max(1, (hi - lo) // _PROBES)
                probes.update(range(lo + step, hi, step))
                # hashes are spread evenly, so look closely where the target should be
                guess = lo + int((hi - lo) * ((goal - below[lo]) / max(1, below[hi] - below[lo])))
                near = max(1, (hi - lo) // 256)
                probes.update(p for p in (guess - near, guess, guess + near) if lo < p < hi)
        if not probes:
            break
        ordered = sorted(probes)
        seen = 0
        for key, (size, _) in zip(ordered, _histogram(keyed, ordered)):
            seen += size
            below[key] = seen
        known = sorted(below)
        sums = [below[k] for k in known]
        for i, goal in enumerate(targets):
            at = int(np.searchsorted(sums, goal, side="right"))
            low[i] = max(low[i], known[at - 1])
            high[i] = min(high[i], known[at]) if at < len(known) else high[i]
        ends = {0, 1 << 128, *low, *high}
        below = {k: v for k, v in below.items() if k in ends}
    return sorted(lo if goal - below[lo] <= below[hi] - goal else hi for lo, hi, goal in zip(low, high, targets))


def shard_by_bytes(
    docs: DataFrame,
    text_col: str = "text",
    shards: int = SHARDS,
    tolerance: float = TOLERANCE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``size`` (UTF-8 bytes of the text and 1), ``shard`` and ``slot`` (gapless from 0 in its shard).

    A null text has size 1 and is ordered as the empty text. Rows that agree in
    every column are one unit to the boundaries, so they stay in one block. An
    empty table stays empty. Columns named like the three new ones are replaced.
    """
    keep = other_columns(docs, "size", "shard", "slot")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{f.name}`") for f in keep]).alias("row"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.xxhash64(text).alias("high"),
        hash_of(keep, F.lit(1)).alias("low"),
    )
    keyed = materialize(rows.select("high", "low", "size"))
    total = keyed.agg(F.sum("size")).first()[0] or 0
    per_shard = min(MAX_BLOCKS, max(1, -(-total // (shards * block_bytes))))
    splitters = find_splitters(keyed, shards * per_shard, tolerance)
    counts = [n for _, n in _histogram(keyed, splitters)]
    first = [sum(counts[b - b % per_shard : b]) for b in range(len(counts))]

    parts = [_part(k) for k in splitters]
    block = _number_not_above(F.col("high"), F.col("low"), parts)
    placed = rows.withColumn("block", block).repartitionById(len(counts), "block").sortWithinPartitions("high", "low")
    # a block is a partition, so the low bits count its rows from 0
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    offsets = F.array(*[F.lit(n).cast("bigint") for n in first])
    return placed.select(
        "row.*",
        "size",
        F.floor(F.col("block") / per_shard).cast("int").alias("shard"),
        (index + F.get(offsets, F.col("block"))).alias("slot"),
    )


def _number_not_above(high: Column, low: Column, keys: Sequence[tuple[int, int]]) -> Column:
    """How many of the sorted keys are not above (high, low): a binary search written as an expression."""
    if not keys:
        return F.lit(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        a, b = keys[mid]
        return F.when((high < a) | ((high == a) & (low < b)), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(keys))


@register("op7_histogram_sort_shards")
def op7(spark, folder):
    sharded = shard_by_bytes(table(spark, folder, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
