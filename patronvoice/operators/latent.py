"""Latent semantic vectors: a randomised truncated SVD of the TF-IDF table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronvoice.operators.terms import tokens
from patronvoice.session import materialize

#: Words are hashed to so many buckets: few of them share one, and the size of the
#: term matrix (buckets x probes) is known before any text is read.
FEATURES = 1 << 16
#: Times the probes pass through the table; all their images together span the searched space.
PASSES = 8
#: The searched space has so many dimensions per wanted one, and at least so many in all.
SPAN, LEAST_SPAN = 4, 64
#: The largest searched space, in bytes of its base.
SPACE_BYTES = 512 << 20
#: Texts multiplied at once; bounds the memory of a task beside the term matrix.
ROWS = 512


@dataclass(frozen=True)
class LatentModel:
    """What `fit_latent` learns: the weight of each word bucket, and its place in each direction."""

    stop: tuple[str, ...]
    idf: np.ndarray = field(repr=False)
    directions: np.ndarray = field(repr=False)
    singular_values: np.ndarray

    def transform(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        """Adds unit-length array<double> vectors, for new texts too.

        A null text, one without words or with no known word has the zero vector.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.idf, self.directions))

        @F.pandas_udf("array<double>")
        def project(buckets: pd.Series) -> pd.Series:
            idf, directions = shared.value
            found = np.zeros((len(buckets), directions.shape[1]))
            for at, words in enumerate(buckets):
                some, tf = np.unique(words, return_counts=True)
                found[at] = _weights(tf, idf[some]) @ directions[some]
            norms = np.linalg.norm(found, axis=1, keepdims=True)
            # what is left of a text outside all directions is rounding, not a direction
            return pd.Series(list(np.where(norms > 1e-9, found / np.maximum(norms, 1e-300), 0.0)), index=buckets.index)

        return df.withColumn(out_col, project(_buckets(F.col(text_col), len(self.idf), self.stop)))


def fit_latent(
    df: DataFrame,
    text_col: str,
    dims: int = 64,
    stop: Sequence[str] = (),
    features: int = FEATURES,
    passes: int = PASSES,
    seed: int = 42,
) -> LatentModel:
    """The ``dims`` leading right singular directions of the unit-length TF-IDF rows of all texts.

    A block of random probes X passes ``passes`` times through A'A, each time made
    orthogonal to what was found before; the best directions in the space of all blocks
    are taken (block Lanczos with a Rayleigh-Ritz step). A'AX is summed row by row: every
    task multiplies its own rows and hands on one sum per word bucket it has seen, which
    Spark adds up before and after the exchange. There are as many tasks as cores, so a pass
    exchanges at most one block per core, whatever the number of texts, and no two texts ever meet. Tasks hold
    one block, the driver the blocks of all passes: twice ``features x SPAN x dims`` doubles,
    64 directions at the least. This is fixed by the arguments and checked, it does not grow with the table.

    Signs are fixed by the largest entry, so the vectors do not depend on partitions
    beyond rounding. Where the table has fewer directions than ``dims``, the rest have
    singular value 0 and no weight.
    """
    width = -(-max(SPAN * dims, LEAST_SPAN) // passes)
    if not 0 < width * passes <= features:
        raise ValueError(f"{width * passes} probes need as many word buckets, not {features}")
    if features * width * passes * 8 > SPACE_BYTES:
        raise ValueError(f"a base of {features} x {width * passes} doubles is larger than {SPACE_BYTES} bytes")
    rows = _spread(_counted(df.select(_buckets(F.col(text_col), features, stop).alias("buckets"))))
    idf = _idf(rows, features)
    space = np.zeros((features, 0))
    images = np.zeros((features, 0))
    block = np.random.default_rng(seed).standard_normal((features, width))
    for _ in range(passes):
        block = _unseen(block, space)
        if not block.shape[1]:
            break  # the searched space holds all directions of the table
        image = _gram_times(rows, idf, block)
        space, images, block = np.hstack([space, block]), np.hstack([images, image]), image
    small = space.T @ images
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:dims]
    found = np.maximum(values[order], 0.0)
    values, directions = np.zeros(dims), np.zeros((features, dims))
    values[: len(found)] = found
    directions[:, : len(found)] = np.where(found > 1e-12 * max(found[0], 1e-300), space @ turn[:, order], 0.0)
    top = directions[np.abs(directions).argmax(axis=0), np.arange(dims)]
    return LatentModel(tuple(stop), idf, directions * np.where(top < 0, -1.0, 1.0), np.sqrt(values))


def _unseen(block: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Orthonormal base of what the block adds to the space, which rounding alone does not."""
    scale = np.linalg.norm(block, axis=0).max()
    for _ in range(2):
        block = block - space @ (space.T @ block)
    base, corner = np.linalg.qr(block)
    turn, sizes, _ = np.linalg.svd(corner)
    base = base @ turn[:, sizes > 1e-8 * scale]
    return np.linalg.qr(base - space @ (space.T @ base))[0]


def _spread(df: DataFrame) -> DataFrame:
    """The table written once; one too small to occupy all cores is spread over them first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    written = materialize(df)
    return written if written.rdd.getNumPartitions() >= cores else materialize(written.repartition(cores))


def _buckets(text: Column, features: int, stop: Sequence[str]) -> Column:
    words = tokens(F.coalesce(text, F.lit("")), stop)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _counted(rows: DataFrame) -> DataFrame:
    """(buckets, tf): the different buckets of each text in order, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                words, ends = _flat(batch.column(0).slice(at, ROWS))
                row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                places, tf = np.unique(row << 32 | words, return_counts=True)
                ends = pa.array(np.searchsorted(places, np.arange(len(ends)) << 32).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (places & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays(lists, names=["buckets", "tf"])

    return rows.mapInArrow(run, "buckets array<int>, tf array<int>")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and where each list begins and ends in them."""
    ends = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), ends - ends[0]


def _idf(rows: DataFrame, features: int) -> np.ndarray:
    """ln((texts + 1) / (texts with the bucket + 1)), at most ``features`` numbers."""
    seen = rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = seen.toArrow()
    idf = np.zeros(features)
    idf[counts["bucket"].to_numpy()] = np.log((rows.count() + 1) / (counts["n"].to_numpy() + 1))
    return idf


def _weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The unit-length TF-IDF weights of one text."""
    weight = tf * idf
    norm = np.sqrt(weight @ weight)
    return weight / norm if norm > 0 else weight


def _gram_times(rows: DataFrame, idf: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A'A times the base, A being the TF-IDF rows of the table."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((idf, base))
    names = [f"p{i}" for i in range(base.shape[1])]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, probes = shared.value
        total = np.zeros_like(probes)
        seen = np.zeros(len(probes), dtype=bool)
        for batch in batches:
            buckets, ends = _flat(batch.column(0))
            tf, _ = _flat(batch.column(1))
            seen[buckets] = True
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                some = buckets[start:end]
                weight = _weights(tf[start:end], idf[some])
                # the buckets of a text are different, so none is added to twice
                total[some] += weight[:, None] * (weight @ probes[some])
        found = np.flatnonzero(seen)
        for at in range(0, len(found), 4096):
            some = found[at : at + 4096]
            yield pa.RecordBatch.from_arrays([*map(pa.array, total[some].T), pa.array(some.astype(np.int32))], names=[*names, "bucket"])

    sums = rows.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(multiply, ", ".join(f"{n} double" for n in names) + ", bucket int")
    added = sums.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros_like(base)
    if added.num_rows:
        out[added["bucket"].to_numpy()] = np.column_stack([added[n].to_numpy() for n in names])
    shared.unpersist()
    return out
