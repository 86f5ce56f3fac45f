"""Near-duplicate embeddings by the epsilon grid order join.

Unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2t). Vectors
are projected onto the leading principal directions, sorted by the grid cells of
side eps there, and cut into short sequence blocks that know the interval of each
projection. Pairs of sequence intervals are joined recursively, from one interval
that holds everything down to pairs of blocks; a pair whose intervals are farther
apart than eps in the projections is skipped, which loses nothing, as a
projection never lengthens a distance. Only the pairs of blocks that are left
compare vectors, exactly and in double precision.

Equal vectors are folded into one beforehand, and a pair of blocks gives counts
per vector and a forest of its links, never the pairs: a dense group costs no
more rows than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronvoice.llm.common import components, register, table
from patronvoice.session import materialize

COSINE = 0.98
BLOCK = 128
DIRECTIONS = 6
#: The directions are fitted on about this many vectors; they decide what is skipped, not what is found.
FIT_ROWS = 50_000
_FAN = 16  # blocks, or intervals, that one interval joins


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows at unit length; scaled first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _rows(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def principal_directions(nodes: DataFrame, dims: int, count: int, directions: int = DIRECTIONS) -> np.ndarray:
    """The leading directions of the unit vectors, from partition sums over a bounded share of them."""
    keep = min(1.0, FIT_ROWS / max(count, 1))
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(keep * (1 << 20)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, first, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            x = _unit(_rows(batch.column(0)))
            second += x.T @ x
            first += x.sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([np.append(first, second).tobytes()], pa.binary())], names=["n", "sums"])

    sums, n = np.zeros(dims + dims * dims), 0
    for r in sample.select("embedding").coalesce(8).mapInArrow(partial, "n bigint, sums binary").collect():
        sums += np.frombuffer(r["sums"])
        n += r["n"]
    if not n:
        return np.eye(dims)[:, :directions]
    mean = sums[:dims] / n
    values, vectors = np.linalg.eigh(sums[dims:].reshape(dims, dims) / n - np.outer(mean, mean))
    return vectors[:, np.argsort(-values, kind="stable")[:directions]]


def _sequence(nodes: DataFrame, axes: np.ndarray, eps: float, block: int) -> DataFrame:
    """Blocks of the grid order: (label, part, seq, nodes, copies, vectors, lo, hi)."""
    k = axes.shape[1]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                seen = _unit(_rows(batch.column(3))) @ axes
                cells = np.floor(seen / eps).astype(np.int32)
                columns = [*batch.columns, *(pa.array(cells[:, i]) for i in range(k)), pa.array(list(seen), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(f"cell{i}" for i in range(k)), "seen"])

    cell = [f"cell{i}" for i in range(k)]
    schema = "label bigint, node bigint, copies bigint, embedding array<double>, " + ", ".join(f"{c} int" for c in cell)
    order = ["label", *cell, "node"]
    sized = nodes.select(F.col("label").cast("bigint"), "node", "copies", F.col("embedding").cast("array<double>"))
    placed = materialize(sized.mapInArrow(project, schema + ", seen array<double>")).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held.append(batch.select(["label", "node", "copies", "embedding", "seen"]))
            if sum(map(len, held)) >= 16 * block:
                rows = pa.Table.from_batches(held).combine_chunks()
                done, rest = blocks(rows, part, seq, last=False)
                yield from done
                seq += len(done)
                held = rest.to_batches()
        if held:
            yield from blocks(pa.Table.from_batches(held).combine_chunks(), part, seq, last=True)[0]

    def blocks(rows: pa.Table, part: int, seq: int, last: bool):
        label = rows.column("label").to_numpy()
        starts = np.append(0, np.flatnonzero(np.diff(label)) + 1)
        bounds = [(int(b), min(int(b) + block, int(e))) for s, e in zip(starts, np.append(starts[1:], len(label))) for b in range(int(s), int(e), block)]
        rest = rows.slice(len(label))
        if not last and bounds:  # the last block may go on
            rest = rows.slice(bounds[-1][0])
            bounds.pop()
        out = []
        for a, b in bounds:
            own = rows.slice(a, b - a).combine_chunks()
            seen = np.stack(own.column("seen").to_pylist())
            raw = np.stack(own.column("embedding").to_pylist())
            values = [
                pa.array([int(label[a])], pa.int64()),
                pa.array([part], pa.int64()),
                pa.array([seq + len(out)], pa.int64()),
                pa.array([own.column("node").to_numpy().astype("<i8").tobytes()], pa.binary()),
                pa.array([own.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                pa.array([raw.astype("<f8").tobytes()], pa.binary()),
                pa.array([seen.min(axis=0).tolist()], pa.list_(pa.float64())),
                pa.array([seen.max(axis=0).tolist()], pa.list_(pa.float64())),
            ]
            out.append(pa.RecordBatch.from_arrays(values, names=["label", "part", "seq", "nodes", "copies", "vectors", "lo", "hi"]))
        return out, rest

    return placed.mapInArrow(
        cut, "label bigint, part bigint, seq bigint, nodes binary, copies binary, vectors binary, lo array<double>, hi array<double>"
    )


def _close(a: str, b: str, eps: float):
    """Whether two intervals of the sequence can hold vectors within eps of each other."""
    gap = F.greatest
    parts = F.zip_with(
        F.zip_with(F.col(f"{a}.lo"), F.col(f"{b}.hi"), lambda x, y: x - y),
        F.zip_with(F.col(f"{b}.lo"), F.col(f"{a}.hi"), lambda x, y: x - y),
        lambda x, y: gap(x, y, F.lit(0.0)),
    )
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x) <= (eps * eps) * (1 + 1e-9) + 1e-12


def _ends(dims: int) -> list:
    return [F.array(*[f(F.col(c)[i]) for i in range(dims)]).alias(c) for c, f in (("lo", F.min), ("hi", F.max))]


def block_pairs(heads: DataFrame, eps: float, dims: int, top: int) -> DataFrame:
    """(label, a, b), a <= b: the pairs of blocks that the recursive join does not skip.

    ``heads`` has (label, leaf, lo, hi); leaves are numbered along the sequence,
    below ``top``. An interval of the next level joins ``_FAN`` neighbours.
    """
    levels = [heads.select("label", F.col("leaf").alias("i"), "lo", "hi")]
    while top > 1:
        top = -(-top // _FAN)
        below = levels[-1]
        levels.append(materialize(below.withColumn("i", F.floor(F.col("i") / _FAN)).groupBy("label", "i").agg(*_ends(dims))))
    pairs = levels[-1].select("label", F.col("i").alias("a"), F.col("i").alias("b"))
    for level in reversed(levels[:-1]):
        child = level.withColumn("up", F.floor(F.col("i") / _FAN))
        left = pairs.alias("p").join(child.alias("x"), (F.col("p.label") == F.col("x.label")) & (F.col("p.a") == F.col("x.up")))
        both = left.join(child.alias("y"), (F.col("p.label") == F.col("y.label")) & (F.col("p.b") == F.col("y.up")))
        near = (F.col("x.i") <= F.col("y.i")) & _close("x", "y", eps)
        pairs = materialize(both.where(near).select(F.col("p.label").alias("label"), F.col("x.i").alias("a"), F.col("y.i").alias("b")))
    return pairs


def _compare(cosine: float, dims: int):
    """Exact links of two blocks as rows: a vector's number of links, and the edges of a forest."""

    def links(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lx, ly = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
        dot = (x @ y.T) / np.outer(lx, ly)
        linked = dot >= cosine
        for i, j in np.argwhere(np.abs(dot - cosine) < 1e-12):  # decided without the matrix product's order of sums
            linked[i, j] = (x[i] * y[j]).sum() / (lx[i] * ly[j]) >= cosine
        return linked

    def forest(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the two sides: linked vectors get one label, the least place on the first side."""
        big = len(linked)
        a = np.arange(big)
        while True:
            b = np.where(linked, a[:, None], big).min(axis=0)
            if same:
                b = np.minimum(b, a)
            now = np.minimum(a, np.where(linked, b[None, :], big).min(axis=1))
            if same:
                now = np.minimum(now, b)
            if (now == a).all():
                return a, b
            a = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, to, n = [], [], []
            for i in range(len(batch)):
                na, ca, va, nb, cb, vb = (np.frombuffer(batch.column(c)[i].as_py(), "<f8" if c % 3 == 2 else "<i8") for c in range(6))
                same = bool(na[0] == nb[0])
                # scaling changes no cosine; it keeps squares in range
                x, y = (v.reshape(-1, dims) / np.abs(v.reshape(-1, dims)).max(axis=1, keepdims=True) for v in (va, vb))
                linked = links(x, y)
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                la, lb = forest(linked, same)
                count_a, count_b = linked @ cb, linked.T @ ca
                sides = [(na, count_a, la)] if same else [(na, count_a, la), (nb, count_b, lb)]
                for names, count, label in sides:
                    some = count > 0
                    at += names[some].tolist()
                    to += na[label[some]].tolist()
                    n += count[some].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (at, to, n)], names=["node", "to", "n"])

    return run


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows with equal labels are linked when their cosine reaches ``cosine``.
    ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable. Null labels, null, empty and
    zero vectors, and vectors with a null or non-finite component link with
    nothing; so do vectors of different length. Repeated rows are rows of their
    own, linked to each other. Null ids stay null and never name a component
    unless no other id is in it. An empty table gives no row. Only the three
    named columns are looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    vec = F.col("embedding")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("embedding"), F.col(label_col).cast("bigint").alias("label"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    folded = (
        rows.where("usable")
        .groupBy("label", "embedding")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    folded = materialize(folded)
    lone = [F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")]
    found = None
    # one search per length of vector; a table has one, as a rule
    for dims in [r["d"] for r in folded.select(F.size("embedding").alias("d")).distinct().collect()]:
        part = _search(folded.where(F.size("embedding") == dims), dims, cosine, block)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), *lone, F.lit(True).alias("kept"))
    found = materialize(found)
    edges = found.where("node <> to")
    classes = components(edges, "node", "to")
    linked = found.groupBy("node").agg(F.sum("n").alias("n"))
    nodes = folded.join(classes, "node", "left").join(linked, "node", "left")
    nodes = nodes.select(
        "label", "embedding", "first", F.coalesce("component", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    nodes = materialize(nodes)
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    whole = nodes.join(least, "root").select("label", "embedding", "n_links", "component_id")
    joined = rows.where("usable").join(whole, ["label", "embedding"]).select("id", "n_links", "component_id")
    out = joined.union(rows.where("NOT usable").select("id", *lone))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _search(nodes: DataFrame, dims: int, cosine: float, block: int) -> DataFrame:
    """(node, to, n): links of a vector within a pair of blocks, and a vector of its component there."""
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7)
    axes = principal_directions(nodes, dims, nodes.count(), min(dims, DIRECTIONS))
    blocks = materialize(_sequence(nodes, axes, eps, block))
    ends = blocks.agg(F.max("part"), F.max("seq")).first()
    bits = int(ends[1]).bit_length()
    leaf = F.shiftleft("part", bits) + F.col("seq")
    blocks = blocks.withColumn("leaf", leaf)
    pairs = block_pairs(blocks.select("label", "leaf", "lo", "hi"), eps, axes.shape[1], (int(ends[0]) + 1) << bits)
    side = lambda s: blocks.select("label", F.col("leaf").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("nodes", "copies", "vectors")])
    both = pairs.join(side("a"), ["label", "a"]).join(side("b"), ["label", "b"])
    data = both.select(*[f"{s}_{c}" for s in "ab" for c in ("nodes", "copies", "vectors")])
    return data.mapInArrow(_compare(cosine, dims), "node bigint, to bigint, n bigint")


OP10_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN least ON vec_id = least.a
"""


@register("op10_epsilon_grid_order", OP10_SQL)
def op10(spark, folder):
    return near_vectors(table(spark, folder, "embeddings"))
