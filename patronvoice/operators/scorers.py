"""Scorers: anything that adds ``raw_label`` (POSITIVE/NEGATIVE) and ``score``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronvoice.functions import truncate_for_model
from patronvoice.functions.scores import NEUTRAL_THRESHOLD
from patronvoice.operators.sentiment import add_sentiment


class Scorer(Protocol):
    def __call__(self, df: DataFrame, text_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class LabelScorer:
    """Label and score are already columns of the table."""

    label_col: str = "raw_label"
    score_col: str = "score"

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumns({"raw_label": F.col(self.label_col), "score": F.col(self.score_col)})


@dataclass(frozen=True)
class ConstantScorer:
    """The same label and confidence for every text."""

    label: str
    score: float

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        return df.withColumns({"raw_label": F.lit(self.label), "score": F.lit(self.score)})


@dataclass(frozen=True)
class ModelScorer:
    """A fitted Spark ML model; the confidence is the larger class probability."""

    model: PipelineModel

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        scored = self.model.transform(df.withColumn("_text", truncate_for_model(F.coalesce(F.col(text_col), F.lit("")))))
        positive = vector_to_array("_probability")[1]
        return (
            scored.withColumn("_positive", positive)
            .withColumn("raw_label", F.when(F.col("_positive") >= 0.5, "POSITIVE").otherwise("NEGATIVE"))
            .withColumn("score", F.greatest("_positive", 1 - F.col("_positive")))
            .select(*df.columns, "raw_label", "score")
        )


def train_scorer(
    df: DataFrame,
    text_col: str,
    label_col: str,
    features: int = 1 << 16,
    max_iter: int = 20,
    reg: float = 0.01,
) -> ModelScorer | ConstantScorer:
    """Logistic regression on hashed TF-IDF; ``label_col`` is 1 positive, 0 negative, null unused.

    A null text has no words. Without rows of both classes every text gets the
    one class there is (positive without any), with a confidence of 1 (0.5).
    """
    rows = df.where(F.col(label_col).isNotNull()).select(
        truncate_for_model(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), F.col(label_col).cast("double").alias("_label")
    )
    # at most two classes
    classes = [r["_label"] for r in rows.select("_label").distinct().limit(2).collect()]
    if len(classes) < 2:
        return ConstantScorer("POSITIVE" if classes != [0.0] else "NEGATIVE", 1.0 if classes else 0.5)
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf", minDocFreq=2),
        LogisticRegression(
            featuresCol="_tfidf",
            labelCol="_label",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_prediction",
            maxIter=max_iter,
            regParam=reg,
        ),
    ]
    return ModelScorer(Pipeline(stages=stages).fit(rows))


def star_label(rating, low: float = 2.0, high: float = 4.0):
    """Weak label from a rating text such as ``Rated 4.0``: 1, 0, or null in between."""
    stars = F.regexp_extract(rating, r"([0-9]+\.?[0-9]*)", 1).try_cast("double")
    return F.when(stars >= high, 1).when(stars <= low, 0)


@dataclass(frozen=True)
class BatchScorer:
    """A model that lives in Python, called with lists of texts.

    ``factory`` runs once per Python worker and returns a function from a list of
    texts to a list of (label, score). The text is handed over whole unless the
    model needs ``max_chars``. ``balance_on`` names columns to spread the rows by
    beforehand, for inputs where one entity's reviews sit in one partition and
    the model is what takes the time.
    """

    factory: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]
    batch_size: int = 32
    max_chars: int | None = None
    balance_on: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        factory, size = self.factory, self.batch_size

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            predict = factory()
            for frame in frames:
                texts = frame["_text"].fillna("").tolist()
                found = [pair for i in range(0, len(texts), size) for pair in predict(texts[i : i + size])]
                frame = frame.drop(columns="_text")
                frame["raw_label"] = [label for label, _ in found]
                frame["score"] = [float(score) for _, score in found]
                yield frame

        schema = T.StructType(
            [*df.schema.fields, T.StructField("raw_label", T.StringType()), T.StructField("score", T.DoubleType())]
        )
        if self.balance_on:
            df = df.repartition(*self.balance_on)
        return df.withColumn("_text", truncate_for_model(F.col(text_col), self.max_chars)).mapInPandas(run, schema)


def score_sentiment(
    df: DataFrame, text_col: str, scorer: Scorer, threshold: float = NEUTRAL_THRESHOLD
) -> DataFrame:
    """Scored reviews: raw label, confidence, class and signed score on the same row."""
    return add_sentiment(scorer(df, text_col), threshold=threshold).drop("score")
