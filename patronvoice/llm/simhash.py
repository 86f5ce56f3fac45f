"""Near-duplicates by 64-bit SimHash, found with the generalised pigeonhole principle.

Distinct fingerprints are indexed by groups of correlated bits. A group i with
threshold t_i is probed with every value within t_i bits; if the thresholds of
all groups plus one each sum to the wanted distance plus one, no pair within that
distance is missed. A threshold of -1 skips a group. Dynamic programming picks
the thresholds (and so which groups to skip or to probe wider) by the candidates
they are estimated to bring: the number of pairs that agree on a group is counted
over all fingerprints, wider balls are extrapolated from the bits' frequencies.

A crowded bucket never emits its pairs. Its members agree on the bucket's bits,
so the same principle is applied again to the bits that are left, until the
buckets are small. Pairs are verified by their distance inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from patronvoice.llm.common import components, fresh, hash_of, register, table
from patronvoice.session import materialize

BITS, DISTANCE, SHINGLE, SEED = 64, 2, 3, 42
#: Buckets with more fingerprints are split by further bits, this many times at most.
CROWDED, DEPTH = 64, 4
_BATCH = 100_000  # shingles whose bits are summed at once
_ROWS = 512  # texts held as Python strings at once


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    return np.array([xxh64_intdigest(text[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], dtype=np.uint64)


def _bit_sums(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of hashes, how many have each bit set; bit 0 is the lowest."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprint_values(texts: Sequence[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints as unsigned 64-bit integers; null and wordless texts have 0."""
    out = np.zeros(len(texts), dtype=np.uint64)
    weight = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    owners, runs, held = [], [], 0

    def flush() -> None:
        nonlocal owners, runs, held
        if owners:
            sizes = np.array([len(r) for r in runs])
            sums = _bit_sums(np.concatenate(runs), np.cumsum(sizes) - sizes)
            out[owners] = ((2 * sums > sizes[:, None]) * weight).sum(axis=1, dtype=np.uint64)
        owners, runs, held = [], [], 0

    for i, text in enumerate(texts):
        # bytes.lower and bytes.split know ASCII alone: A-Z, and space with tab to carriage return
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if len(words) > _BATCH:  # part by part, with the overlap that shingles need
            total, n = np.zeros(BITS, dtype=np.int64), len(words) - shingle + 1
            for at in range(0, n, _BATCH):
                part = _hashes(words[at : min(at + _BATCH, n) + shingle - 1], shingle)
                total += _bit_sums(part, np.array([0]))[0]
            out[i] = ((2 * total > n) * weight).sum(dtype=np.uint64)
        elif words:
            owners.append(i)
            runs.append(_hashes(words, shingle))
            held += len(runs[-1])
            if held >= _BATCH:
                flush()
    flush()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                values = fingerprint_values(part.column(1).to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col)).mapInArrow(run, "id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the matrix of bits set together, summed over partitions."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(values), 1 << 16):
                part = values[at : at + (1 << 16)].astype("<i8").view(np.uint8).reshape(-1, 8)
                bits = np.unpackbits(part, axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
                n += len(bits)
        cells = np.append(total.ravel().astype(np.int64), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], names=["cell", "n"])

    parts = prints.select("fp").mapInArrow(partial, "cell bigint, n bigint")
    cells = np.zeros(BITS * BITS + 1)
    for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), cells[:-1].reshape(BITS, BITS)


def correlated_groups(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of near-equal size, correlated bits in one group as far as it goes."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(sorted(free), key=lambda b: r[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: r[b, group].sum()))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def _mask(bits: Sequence[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: Sequence[Sequence[float]], units: int) -> list[int]:
    """Thresholds with sum(t + 1) = ``units`` of least total cost; ``costs[i][t]``, and -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (value, chosen) in best.items():
            for t in range(-1, min(units - used, len(cost))):
                now = value + (cost[t] if t >= 0 else 0.0)
                if used + t + 1 not in step or now < step[used + t + 1][0]:
                    step[used + t + 1] = (now, [*chosen, t])
        best = step
    return best[units][1]


def plan(prints: DataFrame, distance: int = DISTANCE, choices: Sequence[int] = (2, 3, 4)) -> list[tuple[int, int]]:
    """(mask, threshold) of the bit groups to probe: the cheapest of the groupings into 2, 3 or 4 parts."""
    n, together = bit_statistics(prints)
    p = together.diagonal() / max(n, 1)
    same = p * p + (1 - p) * (1 - p)  # two fingerprints agree on the bit
    groupings = [correlated_groups(together, n, k) for k in choices]
    masks = sorted({_mask(g) for grouping in groupings for g in grouping})
    keys = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(_signed(m)).alias("v")) for i, m in enumerate(masks)])
    sizes = prints.select(F.explode(keys).alias("k")).groupBy("k.i", "k.v").agg(F.count(F.lit(1)).alias("c"))
    agree = {r["i"]: r["s"] for r in sizes.groupBy("i").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("s")).collect()}
    best = (float("inf"), [])
    for grouping in groupings:
        costs = []
        for group in grouping:
            exact = agree.get(masks.index(_mask(group)), 0.0)
            odds = [1.0] + [0.0] * distance  # of t disagreements against none, bits taken as independent
            for b in group:
                ratio = (1 - same[b]) / max(same[b], 1e-9)
                odds = [odds[t] + (odds[t - 1] * ratio if t else 0.0) for t in range(distance + 1)]
            probes = list(accumulate(len(list(combinations(group, t))) for t in range(distance + 1)))
            costs.append([exact * s + n * q for s, q in zip(accumulate(odds), probes)])
        chosen = allocate(costs, distance + 1)
        cost = sum(c[t] for c, t in zip(costs, chosen) if t >= 0)
        if cost < best[0]:
            best = (cost, [(_mask(g), t) for g, t in zip(grouping, chosen) if t >= 0])
    return best[1]


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


@lru_cache(maxsize=None)
def _finer(mask: int, parts: int) -> tuple[int, ...]:
    """The bits that ``mask`` leaves, in ``parts`` groups."""
    left = [b for b in range(BITS) if not mask >> b & 1]
    return tuple(_mask(left[k::parts]) for k in range(parts) if left[k::parts])


def _keys(mask: int, threshold: int) -> list[Column]:
    """A fingerprint's place in a group's index, and the places within ``threshold`` bits of it to look up."""
    at = F.col("fp").bitwiseAND(_signed(mask))
    bits = [b for b in range(BITS) if mask >> b & 1]
    flips = [_mask(c) for k in range(threshold + 1) for c in combinations(bits, k)]
    return [
        F.struct(F.lit(_signed(mask)).cast("bigint").alias("mask"), at.bitwiseXOR(_signed(f)).alias("v"), F.lit(f != 0).alias("probe"))
        for f in flips
    ]


def links(prints: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED, depth: int = DEPTH) -> DataFrame:
    """Distinct pairs (a < b) of the distinct fingerprints ``fp`` within ``distance`` bits.

    A bucket holds the fingerprints whose bits under ``mask`` are ``v`` and, where
    the group is probed wider, those that look it up (``probe``). What two of them
    differ in outside the mask is at most ``distance``, so a crowded bucket is
    split by groups of the bits it leaves, whichever side a row is on. A mask that
    leaves no more than ``distance`` bits is not split: its index holds few values.
    """
    groups = plan(prints, distance)
    keys = F.array(*[k for mask, t in groups for k in _keys(mask, t)])
    keyed = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.v", "k.probe")
    masks = [mask for mask, _ in groups]
    near = (F.col("a") < F.col("b")) & (_far("a", "b") <= distance)
    found: list[DataFrame] = []
    for level in range(depth + 1):
        keyed = materialize(keyed)
        masks = [m for m in masks if BITS - m.bit_count() > distance]
        sizes = keyed.groupBy("mask", "v").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("here")).where("n > 1 AND here > 0")
        full = F.col("mask").isin([_signed(m) for m in masks]) & (F.col("n") * F.col("here") > crowded * crowded)
        many = materialize(sizes.where(full)) if level < depth else None
        few = sizes.where(~full) if level < depth else sizes
        rows = keyed.join(few.select("mask", "v"), ["mask", "v"])
        # each pair looks the other up from both ends, so one of them is enough
        here = rows.where("NOT probe").select("mask", "v", F.col("fp").alias("b"))
        pairs = rows.withColumnRenamed("fp", "a").join(here, ["mask", "v"]).where(near)
        found.append(pairs.select("a", "b"))
        if many is None or many.isEmpty():
            break
        finer = {m: _finer(m, distance + 1) for m in masks}
        cases = F.lit(None).cast("array<struct<mask:bigint,v:bigint>>")
        for m, parts in finer.items():
            split = [
                F.struct(F.lit(_signed(m | p)).cast("bigint").alias("mask"), F.col("v").bitwiseOR(F.col("fp").bitwiseAND(_signed(p))).alias("v"))
                for p in parts
            ]
            cases = F.when(F.col("mask") == _signed(m), F.array(*split)).otherwise(cases)
        keyed = keyed.join(many.select("mask", "v"), ["mask", "v"]).select("fp", "probe", F.explode(cases).alias("k"))
        keyed = keyed.select("fp", "k.mask", "k.v", "probe").distinct()
        masks = sorted({m | p for m, parts in finer.items() for p in parts})
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out.distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links of fingerprints.

    Null and wordless texts have fingerprint 0 and link like any other. A row
    with a null id takes part with its text; its component has the smallest id
    that is not null, or null. Repeated rows give one row each; an empty table
    gives none. Only the two named columns are looked at.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle))
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")))
    if prints.isEmpty():
        return rows.select(F.col("id").alias(id_col), "fp", F.col("id").alias("component_id"))
    found = components(links(prints, distance), "a", "b")
    rooted = prints.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(rooted.select("fp", "first", F.coalesce("component", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, null_ids: bool = False, **options) -> DataFrame:
    """``docs`` with one row of each component of texts: the one with the smallest id.

    ``find`` gives each row its component. Rows are told apart by a hash of id and
    text, so that texts of one id are compared like any other and none is lost with
    it; rows equal in both count once. Rows whose id is null stay, each with its
    text; with ``null_ids`` they take part, behind all ids, and one is kept of a
    component that has no id. Only hashes and ids travel until the rows to keep are known.
    """
    key = fresh("_key", docs)
    rows = docs if null_ids else docs.where(F.col(id_col).isNotNull())
    rows = rows.withColumn(key, F.xxhash64(id_col, text_col))
    ids = rows.groupBy(key).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    placed = find(rows, key, text_col, **options).select(key, "component_id").distinct().join(ids, key)
    best = F.min(F.struct(F.col("id").isNull().alias("last"), "id", key, "n")).alias("best")
    kept = materialize(placed.groupBy("component_id").agg(best).select(f"best.{key}", "best.n"))
    out = rows.join(kept.where("n = 1").select(key), key, "left_semi").select(docs.columns)
    repeated = kept.where("n > 1").select(key)
    if not repeated.isEmpty():
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        again = rows.join(repeated, key, "left_semi")
        out = out.union(again.groupBy(key).agg(F.min_by(whole, hash_of(docs.schema.fields)).alias("row")).select("row.*"))
    return out if null_ids else out.union(docs.where(F.col(id_col).isNull()))


@register("op9_simhash_pigeonhole")
def op9(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
