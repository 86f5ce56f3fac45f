"""Centroid clustering in exact integers over dictionaries of subvectors.

Vectors become integers once and are stored in chunks, column by column: each
block of neighbouring dimensions is replaced, without loss, by a dictionary of
its distinct subvectors and one code per vector. Blocks start as single
dimensions and are joined in pairs as long as the dictionary stays small beside
the chunk. A round computes the distances of the dictionary's subvectors to the
centroids' parts, once for each, and a vector's distance is the sum over its
codes. The next centroids come from the same codes: a count per cluster and code
times the subvectors. Only these sums, one row per cluster and dimension, leave a
task; the vectors are shuffled never.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import register, table
from patronvoice.session import materialize

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Vectors of a chunk, and the vectors per dictionary entry that a joined block must keep.
CHUNK_ROWS, REUSE = 16_384, 8
#: Components from here on have no exact squared distance in 64 bits over DIMENSIONS components.
LARGEST = 1 << 27
_CODED = "ids array<bigint>, blocks array<struct<first: int, width: int, entries: binary, codes: binary>>"


def dictionaries(vectors: np.ndarray, reuse: int = REUSE) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first dimension, distinct subvectors, code per vector) that give back the vectors.

    Neighbouring blocks of one width are joined while the subvectors of the joined
    block are at most one for every ``reuse`` vectors.
    """
    blocks = []
    for d in range(vectors.shape[1]):
        entries, codes = np.unique(vectors[:, d], return_inverse=True)
        blocks.append((d, entries[:, None], codes))
    joined = True
    while joined:
        joined, out, at = False, [], 0
        while at < len(blocks):
            pair = blocks[at : at + 2]
            if len(pair) == 2 and pair[0][1].shape[1] == pair[1][1].shape[1]:
                (first, left, a), (_, right, b) = pair
                seen, codes = np.unique(a.astype(np.int64) * len(right) + b, return_inverse=True)
                if len(seen) * reuse <= len(vectors):
                    out.append((first, np.hstack([left[seen // len(right)], right[seen % len(right)]]), codes))
                    joined, at = True, at + 2
                    continue
            out.append(blocks[at])
            at += 1
        blocks = out
    return blocks


def nearest(blocks: Sequence[tuple[int, np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, its squared distance) per vector; the smaller number on ties."""
    total = np.zeros((len(blocks[0][2]), len(centroids)), dtype=np.int64)
    for first, entries, codes in blocks:
        part = entries[:, None, :] - centroids[None, :, first : first + entries.shape[1]]
        total += (part * part).sum(axis=2)[codes]
    own = total.argmin(axis=1)
    return own, total[np.arange(len(own)), own]


def _coded(vectors: DataFrame, chunk_rows: int, reuse: int) -> DataFrame:
    """Chunks (schema ``_CODED``) of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, rows = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), chunk_rows):
                part = batch.slice(at, chunk_rows)
                ids += part.column(0).to_pylist()
                lists = part.column(1)
                held.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1))
                rows += len(part)
                while rows >= chunk_rows:
                    whole = np.concatenate(held)
                    yield chunk(ids[:chunk_rows], whole[:chunk_rows])
                    ids, held, rows = ids[chunk_rows:], [whole[chunk_rows:]], rows - chunk_rows
        if rows:
            yield chunk(ids, np.concatenate(held))

    def chunk(ids: list[int | None], whole: np.ndarray) -> pa.RecordBatch:
        blocks = [
            {"first": f, "width": e.shape[1], "entries": e.astype("<i8").tobytes(), "codes": c.astype("<u2" if len(e) <= 1 << 16 else "<u4").tobytes()}
            for f, e, c in dictionaries(whole, reuse)
        ]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("width", pa.int32()), ("entries", pa.binary()), ("codes", pa.binary())]))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([blocks], kind)], names=["ids", "blocks"])

    return vectors.mapInArrow(run, _CODED)


def _chunks(batches: Iterator[pa.RecordBatch]):
    """(ids, blocks) of each chunk, one at a time."""
    for batch in batches:
        for i in range(len(batch)):
            ids, blocks = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            found = []
            for b in blocks:
                entries = np.frombuffer(b["entries"], dtype="<i8").reshape(-1, b["width"])
                codes = np.frombuffer(b["codes"], dtype="<u2" if len(entries) <= 1 << 16 else "<u4")
                found.append((b["first"], entries, codes))
            yield ids, found


def _sums(coded: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(vectors, exact sums of their components) per cluster; clusters x dimensions rows reach the driver."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for _, blocks in _chunks(batches):
            own, _ = nearest(blocks, centroids)
            count += np.bincount(own, minlength=k)
            for first, entries, codes in blocks:
                uses = np.bincount(own * len(entries) + codes, minlength=k * len(entries)).reshape(k, -1)
                total[:, first : first + entries.shape[1]] += uses @ entries
        some = np.flatnonzero(count)
        columns = [np.repeat(some, dims), np.tile(np.arange(dims), len(some)), total[some].ravel(), np.repeat(count[some], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["cluster", "dim", "total", "n"])

    parts = coded.mapInArrow(run, "cluster bigint, dim bigint, total bigint, n bigint")
    # wide sums: a task's are far below 64 bits, those of all tasks need not be
    rows = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r["cluster"], (r["n"], [0] * dims))[1][r["dim"]] = int(r["total"])
    return out


def cluster_subvectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
    seed: str = SEED,
    chunk_rows: int = CHUNK_ROWS,
    reuse: int = REUSE,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that is kept.

    Kept are vectors of exactly ``dims`` components, none of them null or not
    finite, as integers ``floor(scale * x)``; one whose integers reach ``LARGEST``
    has no exact distance in 64 bits and is left out like a vector that is not
    finite. The first centroids are the vectors with the smallest SHA-256 of
    ``seed:id`` (a null id counts as an empty one, equal ids are ordered by their
    components), fewer than ``k`` if there are not as many. ``distance`` is
    squared; the inertias are its sums over the cluster and over all. Repeated
    rows give one row each. A table without such vectors gives no row. Rounds end
    early once the centroids stand still, as later ones would change nothing.
    Only the two named columns are looked at.
    """
    spark = df.sparkSession
    usable = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(usable)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = rows.orderBy(key, "v").limit(k).collect()
    shape = "id bigint, cluster int, distance bigint"
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), dims)
    if not start:
        empty = spark.createDataFrame([], f"{shape}, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
        return empty.withColumnRenamed("id", id_col)

    coded = materialize(_coded(rows, chunk_rows, reuse))
    for _ in range(rounds):
        moved = centroids.copy()
        for cluster, (n, total) in _sums(coded, centroids).items():
            moved[cluster] = [t // n for t in total]  # Python's integers: exact, and towards minus infinity
        if (moved == centroids).all():
            break
        centroids = moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _chunks(batches):
            own, distance = nearest(blocks, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    assigned = materialize(coded.mapInArrow(assign, shape))
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sums = F.array(*[F.lit(inertia.get(c, 0)).cast("bigint") for c in range(len(centroids))])
    final = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in c]) for c in centroids.tolist()])
    return assigned.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.get(sums, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        F.get(final, F.col("cluster")).alias("centroid"),
    )


def _sql() -> str:
    near = "(SELECT v.vec_id, v.x, first(c.num ORDER BY d, c.num) AS num, min(d) AS d FROM (SELECT v.vec_id, v.x, c.num, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.y[i]) * (v.x[i] - c.y[i]))) AS d FROM v CROSS JOIN c{r} c) v JOIN c{r} c ON c.num = v.num GROUP BY v.vec_id, v.x)"
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS num, x AS y FROM v ORDER BY sha256('3:' || vec_id) LIMIT 8)",
    ]
    for r in range(ROUNDS):
        parts.append(
            f"m{r} AS (SELECT num, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS y FROM {near.format(r=r)} n CROSS JOIN range(1, 65) t(i) GROUP BY num, i)"
        )
        parts.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.num, coalesce(m.y, c.y) AS y FROM c{r} c LEFT JOIN (SELECT num, list(y ORDER BY i) AS y FROM m{r} GROUP BY num) m ON c.num = m.num)"
        )
    parts.append(f"n AS (SELECT * FROM {near.format(r=ROUNDS)})")
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, CAST(n.num AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, "
        "CAST(sum(d) OVER (PARTITION BY n.num) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.y, ',')) AS centroid_sha256 FROM n JOIN c{ROUNDS} c ON n.num = c.num"
    )


@register("op12_subvector_kmeans", _sql())
def op12(spark, folder):
    found = cluster_subvectors(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        "cluster_inertia",
        "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"),
    )
