import pytest
from patronvoice.operators import sentiment as ops
from patronvoice.operators.scorers import BatchScorer, LabelScorer, score_sentiment, star_label, train_scorer
from patronvoice.plans.sentiment import review_sentiment, run_sentiment
from pyspark.sql import functions as F


def _toy():
    # nested, so that it travels to the workers by value
    def factory():
        return lambda texts: [("NEGATIVE" if "bad" in t else "POSITIVE", 0.6 if "meh" in t else 0.91234) for t in texts]

    return factory


toy_model = _toy()


@pytest.fixture(scope="module")
def entities(spark):
    rows = [
        ("u1", "One", ["bad food", "bad meh", "good", "  ", None]),
        ("u2", "Two", ["good"]),
        ("u3", "Three", []),
        ("u4", "Four", None),
        (None, "No key", ["bad"]),
    ]
    return spark.createDataFrame(rows, "url string, name string, review_texts array<string>")


def test_explode_drops_blanks(entities):
    got = sorted((r["name"], r["review_pos"], r["review_text"]) for r in ops.explode_reviews(entities).collect())
    assert got == [("No key", 0, "bad"), ("One", 0, "bad food"), ("One", 1, "bad meh"), ("One", 2, "good"), ("Two", 0, "good")]


def test_whole_job(entities):
    out, reviews = review_sentiment(entities, BatchScorer(toy_model, batch_size=2))
    assert reviews.count() == 5
    rows = {r["name"]: r for r in out.collect()}
    one = rows["One"]
    assert (one["total_reviews"], one["positive_count"], one["negative_count"], one["neutral_count"]) == (3, 1, 1, 1)
    assert one["dominant_sentiment"] == "positive" and one["avg_signed_score"] == 0.0
    assert one["sentiment_volatility"] == pytest.approx(0.9123)
    assert (rows["Two"]["sentiment_volatility"], rows["Two"]["sentiment_positive_pct"]) == (0.0, 100.0)
    for name in ("Three", "Four", "No key"):
        assert (rows[name]["total_reviews"], rows[name]["dominant_sentiment"]) == (0, "neutral")


def test_dominant_ties(spark):
    counts = [(2, 2, 0), (0, 1, 1), (1, 1, 1), (0, 0, 3), (1, 2, 2)]
    df = spark.createDataFrame(counts, "positive_count long, negative_count long, neutral_count long")
    got = [r["dominant_sentiment"] for r in ops.dominant_sentiment(df).collect()]
    assert got == ["positive", "negative", "positive", "neutral", "negative"]


def test_partitioning_does_not_matter(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("url"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "NEGATIVE").otherwise("POSITIVE").alias("raw_label"),
        ((F.col("id") % 64) / 128.0 + 0.5).alias("score"),
    )
    runs = [sorted(ops.class_percentages(ops.sentiment_by_entity(ops.add_sentiment(df.repartition(n)))).drop("sentiment_volatility", "avg_signed_score").collect()) for n in (1, 8)]
    assert runs[0] == runs[1] and sum(r["total_reviews"] for r in runs[0]) == 3000


def test_batch_scorer_options(spark):
    df = spark.createDataFrame([(i, "x" * 2000 + ("bad" if i % 2 else "")) for i in range(10)], "i int, t string")
    whole = {r["i"]: r["raw_label"] for r in score_sentiment(df, "t", BatchScorer(toy_model, balance_on=("i",))).collect()}
    assert whole == {i: "NEGATIVE" if i % 2 else "POSITIVE" for i in range(10)}
    cut = score_sentiment(df, "t", BatchScorer(toy_model, max_chars=512)).where("raw_label = 'NEGATIVE'")
    assert cut.isEmpty()


def test_learned_scorer(spark):
    rows = [(f"{'awful rude cold' if i % 2 else 'lovely tasty warm'} dish {i % 7}", f"Rated {1 if i % 2 else 5}.0") for i in range(60)]
    df = spark.createDataFrame(rows + [("unclear", "Rated 3.0")], "text string, rating string")
    scorer = train_scorer(df.withColumn("label", star_label(F.col("rating"))), "text", "label", features=256)
    test = spark.createDataFrame([("awful and rude", "NEGATIVE"), ("lovely tasty meal", "POSITIVE")], "text string, want string")
    got = score_sentiment(test, "text", scorer, threshold=0.5).collect()
    assert all(r["raw_label"] == r["want"] and 0.5 <= r["confidence"] <= 1 for r in got)
    assert set(got[0].asDict()) == {"text", "want", "raw_label", "sentiment", "confidence", "signed_score"}


def test_summary_and_run(spark, entities, tmp_path):
    entities.write.parquet(str(tmp_path / "cleaned"))
    out = run_sentiment(spark, str(tmp_path / "cleaned"), str(tmp_path / "out"), BatchScorer(toy_model))
    summary = ops.sentiment_summary(out).first()
    assert (summary["total_entities"], summary["entities_with_reviews"], summary["total_reviews_analysed"]) == (5, 2, 4)
    assert summary["dominant_sentiment_counts"] == {"positive": 2, "neutral": 3}
    assert spark.read.json(str(tmp_path / "out/sentiment_summary")).first()["total_entities"] == 5


def test_label_scorer(spark):
    df = spark.createDataFrame([("t", "POSITIVE", 0.74999)], "t string, l string, s double")
    row = score_sentiment(df, "t", LabelScorer("l", "s")).first()
    assert (row["sentiment"], row["confidence"], row["signed_score"]) == ("neutral", 0.75, 0.0)


def test_training_without_two_classes_and_with_null_texts(spark):
    df = spark.createDataFrame([("good", 1), (None, 0), ("bad", 0), ("fine", None)], "t string, label int")
    two = train_scorer(df, "t", "label", features=64)
    assert score_sentiment(df, "t", two).count() == 4
    for rows, label, confidence in ((df.where("label = 0"), "NEGATIVE", 1.0), (df.limit(0), "POSITIVE", 0.5)):
        got = train_scorer(rows, "t", "label")(df, "t").select("raw_label", "score").distinct().collect()
        assert [(r["raw_label"], r["score"]) for r in got] == [(label, confidence)]
