"""Text embeddings, dimension reduction, nearest centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.operators.terms import tokens
from patronvoice.session import materialize


def embed_texts(
    df: DataFrame, text_col: str, dims: int = 256, out_col: str = "embedding", stop: Sequence[str] = ()
) -> DataFrame:
    """Unit-length hashed TF-IDF vectors as array<double>; fitted on ``df`` itself.

    A null text, like one without words, has the zero vector. An empty table stays empty.
    """
    if df.isEmpty():
        return df.withColumn(out_col, F.lit(None).cast("array<double>"))
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    worded = df.withColumn("_words", tokens(F.coalesce(F.col(text_col), F.lit("")), stop))
    model = Pipeline(stages=stages).fit(worded)
    return model.transform(worded).withColumn(out_col, vector_to_array("_unit")).select(*df.columns, out_col)


def encode_batches(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    out_col: str = "embedding",
    batch_size: int = 128,
) -> DataFrame:
    """Embeddings from an encoder living in Python, built once per worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = factory()
        for frame in frames:
            texts = frame[text_col].fillna("").tolist()
            frame[out_col] = [
                np.asarray(v, dtype="float32") for i in range(0, len(texts), batch_size) for v in encode(texts[i : i + batch_size])
            ]
            yield frame

    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.FloatType()))])
    return df.mapInPandas(run, schema)


def reduce_dimensions(df: DataFrame, vec_col: str, k: int = 10, out_col: str = "reduced") -> DataFrame:
    """Unit-length vectors projected on their first k principal components; null stays null."""
    others = df.where(F.col(vec_col).isNull()).withColumn(out_col, F.lit(None).cast("array<double>"))
    rows = df.where(F.col(vec_col).isNotNull()).withColumn("_vec", array_to_vector(F.col(vec_col).cast("array<double>")))
    if rows.isEmpty():
        return others
    stages = [Normalizer(inputCol="_vec", outputCol="_unit"), PCA(k=k, inputCol="_unit", outputCol="_pca")]
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(rows).withColumn(out_col, vector_to_array("_pca")).select(*df.columns, out_col).union(others)


def mean_vectors(df: DataFrame, keys: Sequence[str], vec_col: str, out_col: str = "vector") -> DataFrame:
    """(keys, mean vector, n); vectors are summed before the shuffle."""
    vec = array_to_vector(F.col(vec_col).cast("array<double>"))
    mean = df.groupBy(*keys).agg(Summarizer.mean(vec).alias("_mean"), F.count(F.lit(1)).alias("n"))
    return mean.select(*keys, vector_to_array("_mean").alias(out_col), "n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def assign_topics(
    df: DataFrame,
    vec_col: str,
    centroids: DataFrame,
    id_col: str = "topic_id",
    centroid_col: str = "vector",
    out_col: str = "topic_id",
    chunk: int = 4096,
    group_rows: int = 100_000,
) -> DataFrame:
    """The id of the centroid with the largest cosine, the smallest id on ties.

    Up to ``chunk`` centroids travel to the tasks as one literal matrix. With more
    of them, groups of centroids meet groups of at most about ``group_rows`` rows
    and the best per group is kept and compared; nothing goes by way of the
    driver. A null vector has no topic.
    """
    centroids = materialize(centroids.where(F.col(centroid_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(centroid_col).cast("array<double>").alias("v")))
    count = centroids.count()
    if not count:
        return df.withColumn(out_col, F.lit(None).cast("bigint"))
    vec = F.col(vec_col).cast("array<double>")
    if count <= chunk:
        rows = centroids.orderBy("id").collect()
        found = _nearest(np.array([r[0] for r in rows], dtype="int64"), np.array([r[1] for r in rows], dtype="float64"))
        return df.withColumn("_best", F.when(vec.isNotNull(), found(vec))).withColumn(out_col, -F.col("_best")["negated_id"]).drop("_best")
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))
    parts, salts = math.ceil(count / chunk), math.ceil(max(1, rows.count()) / group_rows)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.where(F.col(vec_col).isNotNull()).select("_row", vec.alias("v"), F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int").alias("salt"), every(parts).alias("part"))
    right = centroids.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), every(salts).alias("salt"))

    def best(points: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if points.empty or some.empty:
            return pd.DataFrame({"_row": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64"), "negated_id": pd.Series(dtype="int64")})
        some = some.sort_values("id")
        return _best_of(points["v"], some["id"].to_numpy(), _units(np.stack(some["v"].to_numpy()))).assign(_row=points["_row"].to_numpy())[["_row", "similarity", "negated_id"]]

    pairs = left.groupBy("part", "salt").cogroup(right.groupBy("part", "salt")).applyInPandas(best, "_row bigint, similarity double, negated_id bigint")
    kept = pairs.groupBy("_row").agg(F.max(F.struct("similarity", "negated_id")).alias("_best"))
    return rows.join(kept, "_row", "left").withColumn(out_col, -F.col("_best")["negated_id"]).drop("_row", "_best")


def _units(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _best_of(vectors: pd.Series, ids: np.ndarray, unit: np.ndarray) -> pd.DataFrame:
    """Similarity and negated id of the best row of ``unit``; ``ids`` rise, so the first of equals is the smallest."""
    similarity = _units(np.stack(vectors.to_numpy())) @ unit.T
    at = similarity.argmax(axis=1)
    return pd.DataFrame({"similarity": similarity[np.arange(len(at)), at], "negated_id": -ids[at]})


def _nearest(ids: np.ndarray, matrix: np.ndarray):
    unit = _units(matrix)

    # the struct orders by similarity, then by smaller id
    @F.pandas_udf("similarity double, negated_id bigint")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"similarity": np.full(len(vectors), np.nan), "negated_id": np.zeros(len(vectors), dtype="int64")}, index=vectors.index)
        known = vectors.notna()
        if known.any():
            out.loc[known] = _best_of(vectors[known], ids, unit).to_numpy()
        return out.astype({"negated_id": "int64"})

    return nearest
