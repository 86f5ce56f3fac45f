"""Document quality: ridge regression on random Fourier features, calibrated isotonically.

A document is a short row of statistics. Cosines of random projections of the
standardised statistics approximate a Gaussian kernel; ridge scores on them come
from normal equations that every partition sums for itself. The scores' order is
then turned into the share of good documents by pooling adjacent violators over
fine bins of the score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.llm.common import fresh, other_columns, register, table
from patronvoice.session import materialize

#: The model is fitted on at most about this many labelled rows, chosen by a hash of their id.
FIT_ROWS = 200_000
FEATURES, RIDGE, WIDTH, SEED = 256, 1e-3, 1.0, 7
THRESHOLD = 0.3
_BINS = 2048
_SUMS = 16  # tasks that sum over the rows of the fit
_CHUNK = 1 << 20  # bytes classified at once
_ROWS = 512  # texts held as Python strings at once

#: classes of bytes; a share of the text each
_CLASSES = ("lower", "upper", "digit", "space", "line", "stop", "shout", "bar", "symbol", "wide")
STATISTICS = (*_CLASSES, "length", "words", "word_length", "distinct", "repeated", "lines", "capital_words")


def _byte_classes() -> np.ndarray:
    of = np.full(256, _CLASSES.index("symbol"), dtype=np.int64)
    of[128:] = _CLASSES.index("wide")
    of[:33] = _CLASSES.index("space")
    for name, chars in (("line", b"\n\r"), ("stop", b".,;:'\"-()"), ("shout", b"!?"), ("bar", b"|<>{}[]\\/")):
        of[list(chars)] = _CLASSES.index(name)
    for name, first, last in (("lower", "a", "z"), ("upper", "A", "Z"), ("digit", "0", "9")):
        of[ord(first) : ord(last) + 1] = _CLASSES.index(name)
    return of


_CLASS_OF = _byte_classes()


def text_statistics(texts: Sequence[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` per text; null and empty texts are all zero."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), len(STATISTICS)))
    k = len(_CLASSES)
    at = 0
    while at < len(raw):  # texts of about _CHUNK bytes together
        end, held = at, 0
        while end < len(raw) and (end == at or held + len(raw[end]) <= _CHUNK):
            held += len(raw[end])
            end += 1
        sizes = np.array([len(r) for r in raw[at:end]])
        counts = np.zeros((end - at) * k, dtype=np.int64)
        if end == at + 1:  # one text of any length, piece by piece
            for i in range(0, held, _CHUNK):
                counts += np.bincount(_CLASS_OF[np.frombuffer(raw[at][i : i + _CHUNK], np.uint8)], minlength=k)
        else:
            row = np.repeat(np.arange(end - at) * k, sizes)
            counts = np.bincount(row + _CLASS_OF[np.frombuffer(b"".join(raw[at:end]), np.uint8)], minlength=len(counts))
        out[at:end, :k] = np.sqrt(counts.reshape(-1, k) / np.maximum(sizes, 1)[:, None])
        at = end
    for row, text in zip(out, raw):
        words = text.split()
        if not words:
            continue
        n = len(words)
        row[k:] = (
            np.log1p(len(text)),
            np.log1p(n),
            np.log1p(len(text) / n),
            len(set(words)) / n,
            np.sqrt(sum(map(eq, words, words[1:])) / n),
            np.log1p(text.count(b"\n")),
            np.sqrt(sum(map(bytes.isupper, words)) / n),
        )
    return out


def document_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the column ``_stats``; it replaces one of that name."""
    df = df.select(*[F.col(f"`{f.name}`") for f in other_columns(df, "_stats")])
    schema = T.StructType([*df.schema.fields, T.StructField("_stats", T.ArrayType(T.DoubleType()))])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                stats = pa.array(list(text_statistics(part.column(place).to_pylist())), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, stats], names=[*batch.schema.names, "_stats"])

    return df.mapInArrow(run, schema)


@dataclass
class QualityModel:
    """All that scoring needs; a few hundred numbers, sent with the tasks."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    scores: np.ndarray
    shares: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        rff = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate([rff, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.scores, self.shares), 0.0, 1.0)


def _summed(rows: DataFrame, values) -> np.ndarray:
    """Sum over all rows of what ``values(stats, label)`` gives for a batch; one result per task comes back."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                stats = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
                part = values(stats, batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"]) for r in rows.select("_stats", "label").mapInArrow(partial, "sums binary").collect()]
    return np.sum(parts, axis=0)


def _isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights):
        pools.append([value * weight, weight, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + n]
    return np.concatenate([np.full(n, a / b) for a, b, n in pools])


def fit_quality(
    stats: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    features: int = FEATURES,
    ridge: float = RIDGE,
    width: float = WIDTH,
    seed: int = SEED,
) -> QualityModel:
    """Fit on the rows of ``stats`` whose id is in ``labels`` with a label 0 or 1.

    Several labels of one id count as their least. Without any labelled row every
    score is 0.5; with one class only it is that class.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"))
    share = min(1.0, fit_rows / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stats.select(F.col(id_col).alias("_id"), "_stats").join(marks, "_id").select("_id", "_stats", "label")
    rows = materialize(rows).repartition(_SUMS, F.pmod(F.xxhash64("_id"), F.lit(_SUMS))).sortWithinPartitions("_id", "_stats")
    rows = materialize(rows).coalesce(_SUMS)

    d = len(STATISTICS)
    sums = _summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)]))
    if sums.ndim == 0:
        flat = np.zeros(d)
        return QualityModel(flat, flat + 1, np.zeros((d, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([0.5]))
    n, mean = sums[0], sums[1 : d + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[d + 1 :] / n - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((d, features)) / (width * np.sqrt(d))
    model = QualityModel(mean, scale, directions, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(1), np.zeros(1))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        phi = model.features(x)
        return np.concatenate([(phi.T @ phi).ravel(), phi.T @ y])

    total = _summed(rows, equations)
    size = features + 1
    penalty = ridge * np.eye(size)
    penalty[-1, -1] = 0.0
    model.weights = np.linalg.solve(total[: size * size].reshape(size, size) / n + penalty / features, total[size * size :] / n)

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        place = np.clip(((raw + 0.5) / 2 * _BINS).astype(int), 0, _BINS - 1)
        return np.concatenate([np.bincount(place, w, _BINS) for w in (np.ones(len(raw)), y, raw)])

    count, good, place = _summed(rows, bins).reshape(3, _BINS)
    some = count > 0
    model.scores = place[some] / count[some]
    model.shares = _isotonic(good[some] / count[some], count[some])
    return model


def score_quality(stats: DataFrame, model: QualityModel, out_col: str = "score") -> DataFrame:
    """``stats`` with the score in place of the statistics; one row per row."""
    keep = other_columns(stats, "_stats", out_col)
    schema = T.StructType([*keep, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                last = batch.num_columns - 1
                score = model.score(np.stack(batch.column(last).to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(score)], names=[*batch.schema.names[:last], out_col])

    return stats.select(*[F.col(f"`{f.name}`") for f in keep], "_stats").mapInArrow(run, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that a fit must not see: crc32 of the id as text, modulo the folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, QualityModel]:
    """(id and statistics of all documents, the model fitted on the labelled ones that are not held out)."""
    stats = materialize(document_statistics(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "_stats"))
    return stats, fit_quality(stats, labels.where(~held_out(F.col(id_col))), id_col, **options)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with the columns they had.

    Null and empty texts get the score of all-zero statistics. Repeated rows are
    scored alike; an empty table stays empty.
    """
    _, model = quality_model(docs, labels, text_col=text_col, **options)
    score = fresh("_score", docs)
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # statistics and score in one worker
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                scores = model.score(text_statistics(part.column(place).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, schema).where(F.col(score) >= threshold).drop(score)


@register("op1_rff_quality")
def op1(spark, folder):
    stats, model = quality_model(table(spark, folder, "documents"), table(spark, folder, "labels"))
    scored = score_quality(stats, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
