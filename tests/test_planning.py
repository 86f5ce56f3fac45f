import pytest
from patronvoice.operators import breakdowns as b
from patronvoice.operators import planning as ops
from patronvoice.operators import search as s
from patronvoice.sources.fixed import recommendations, rice_features
from patronvoice.sources.readers import cap_rows, read_serving_tables
from patronvoice.sources.synthetic import demo_topics, synthesize_listings, synthesize_reviews
from pyspark.sql import functions as F

# computed by hand from reach x impact x confidence / effort
GOLDEN = {
    "Price breakdown upfront": 299,
    "Service rating split": 299,
    "Freshness score algo": 238,
    "Hygiene fast-track alerts": 238,
    "Delivery buffer toggle": 140,
    "Serving size tag on menu": 131,
    "Refund tracker in app": 119,
    "Digital packing checklist": 97,
    "Packaging quality rating": 94,
    "Priority support escalation": 88,
    "Substitution consent flow": 87,
    "Auto-refund missing items": 74,
    "Rider surge signal in UI": 56,
    "Value score badge": 56,
    "Photo verify on delivery": 46,
    "Dynamic ETA engine": 39,
    "Thermal packaging mandate": 37,
    "Staff training badge": 20,
}


def test_rice_golden(spark):
    rows = ops.rice_table(rice_features(spark)).collect()
    assert {r["feature"]: r["rice"] for r in rows} == GOLDEN
    assert [r["rice"] for r in rows] == sorted(GOLDEN.values(), reverse=True)
    summary = ops.rice_summary(ops.add_rice(rice_features(spark))).first()
    assert tuple(summary) == (18, 8, 299, 91.0)


def test_rice_views(spark):
    rice = ops.add_rice(rice_features(spark))
    assert [r["feature"] for r in ops.rice_table(rice_features(spark), sprint=3).collect()] == ["Staff training badge"]
    assert ops.rice_table(rice_features(spark), topic="Portion").count() == 3
    ranked = ops.rice_table(rice_features(spark), by="effort", k=5).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4, 5] and [r["effort"] for r in ranked] == [0.5] * 4 + [1.0]
    what_if = ops.rice_what_if(rice, 50, 2, 75, 2).first()
    assert tuple(what_if) == (38, 91.0, "Below")
    assert ops.rice_effort_tradeoff(rice).columns == ["feature", "effort", "rice", "reach", "sprint"]


def test_recommendations(spark):
    topics = spark.createDataFrame([(0, "Food quality", 10, 40.0), (1, "Food quality", 5, 20.0)], "topic_id long, topic_label string, frequency long, pct double")
    got = ops.recommendations_by_topic(topics, recommendations(spark, "Acme"))
    assert got.count() == 4 * 3 * 3
    food = got.where("topic = 'Food quality'").first()
    assert (food["frequency"], food["pct"]) == (15, 60.0) and "blamed on Acme" in food["pain"][0]
    assert got.where("topic = 'Staff & service'").first()["frequency"] == 1760
    assert ops.recommendations_by_topic(topics, recommendations(spark), "Food quality").count() == 9


def test_generators_do_not_depend_on_partitioning(spark):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    three = synthesize_listings(spark, 500).collect()
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert three == synthesize_listings(spark, 500).collect()
    assert synthesize_listings(spark, 500, seed=1).collect() != three


def test_generated_shape(spark):
    df = synthesize_listings(spark, 5000)
    share = {r["dominant_sentiment"]: r["count"] / 5000 for r in df.groupBy("dominant_sentiment").count().collect()}
    assert share == pytest.approx({"positive": 0.53, "negative": 0.32, "neutral": 0.15}, abs=0.03)
    stats = df.agg(F.min("rate"), F.max("rate"), F.avg("rate"), F.min("votes"), F.max("votes"), F.count("rating_tier")).first()
    assert stats[0] >= 1 and stats[1] <= 5 and abs(stats[2] - 3.7) < 0.05 and stats[3] >= 10 and stats[4] < 50_000 and stats[5] == 5000
    whole = F.col("sentiment_positive_pct") + F.col("sentiment_negative_pct") + F.col("sentiment_neutral_pct")
    assert df.where((whole < 99.9) | (F.col("sentiment_neutral_pct") < 0)).isEmpty()
    assert synthesize_reviews(spark, 300).select("review_text", "topic_label").distinct().count() == 15


def test_serving_tables(spark, tmp_path):
    synthesize_reviews(spark, 40).write.parquet(str(tmp_path / "review_topics"))
    entities, topics, reviews = read_serving_tables(spark, str(tmp_path), review_cap=7)
    assert (entities.count(), topics.count(), reviews.count()) == (5000, 8, 7)
    assert cap_rows(topics, "topic_id", 3).count() == 3


def test_dashboard_on_generated_data(spark):
    df = synthesize_listings(spark, 2000)
    topics = demo_topics(spark)
    assert b.kpi_overview(df).first()["entities"] == 2000
    assert sum(b.class_share(df).first()) == pytest.approx(100)
    assert [r["sentiment"] for r in b.sentiment_distribution(df).orderBy("position").collect()] == ["positive", "neutral", "negative"]
    assert b.type_breakdown(df, 3).count() == 3
    sums = b.complaints_by_city(df).groupBy("listed_city").agg(F.sum("pct").alias("p")).collect()
    assert len(sums) == 6 and all(abs(r["p"] - 100) < 0.5 for r in sums)
    bins = b.topics_over_rating(df, topics).groupBy("rating_bin").agg(F.count("*").alias("n"), F.sum("pct").alias("p")).collect()
    assert len(bins) == 5 and all(r["n"] == 5 and (r["p"] is None or abs(r["p"] - 100) < 1e-6) for r in bins)
    columns = b.topic_by_type_heatmap(df, topics).groupBy("rest_type").agg(F.sum("pct").alias("p")).collect()
    assert len(columns) == 7 and all(abs(r["p"] - 100) < 1e-6 for r in columns)
    assert b.topic_deep_dive(topics, keyword_text=True).first()["keywords"][:2] == ["delivery", "late"]
    sample = [b.score_rating_sample(df.repartition(n), 100).collect() for n in (1, 8)]
    assert sample[0] == sample[1] and len(sample[0]) == 100
    assert b.top_negative_table(df).count() == 12
    assert b.facet_filter(df, ["BTM"], [], "Yes").where("listed_city <> 'BTM' OR online_order <> 'Yes'").isEmpty()
    assert b.distinct_values(df, "rest_type").count() == 7


def test_facets_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "e")
    synthesize_listings(spark, 100).write.parquet(path)
    picked = b.facet_filter(spark.read.parquet(path), ["BTM"], ["Cafe"], "Yes").select("name")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(listed_city,BTM)" in plan and "votes" not in plan.split("ReadSchema")[-1]


def test_search(spark):
    reviews = synthesize_reviews(spark, 600)
    hits = s.search_hits(reviews, "rider turned up|half an hour")
    assert {r["topic_label"] for r in hits.collect()} == {"Delivery & wait time"}
    stats = s.search_stats(hits).first()
    assert stats["results"] == hits.count() and stats["topics"] == 1
    shown = s.search_reviews(reviews, "there was a hair", sentiment="negative", n=5)
    assert shown.count() == 5 and all("<mark>There was a hair</mark>" in r["highlighted"] for r in shown.collect())
    assert s.search_topic_breakdown(hits).first()["count"] == hits.count()
    few = hits.limit(3)
    assert s.search_topic_breakdown(few).isEmpty()
    nothing = s.search_stats(s.search_hits(reviews, "zzz")).first()
    assert (nothing["results"], nothing["positive_pct"]) == (0, None)
    assert s.search_hits(reviews, "(", mode="literal").isEmpty()


def test_histogram_takes_its_range_from_the_data(spark):
    from patronvoice.operators.breakdowns import histogram

    df = spark.createDataFrame([(-3.0,), (7.0,), (2.0,), (None,), (float("inf"),)], "v double")
    got = {r["bin"]: (r["count"], r["bin_start"]) for r in histogram(df, "v", [], None, None, 5).collect()}
    assert got == {0: (1, -3.0), 2: (1, 1.0), 4: (1, 5.0)}
    assert [r["count"] for r in histogram(df.where("v = 2"), "v", [], None, None, 5).collect()] == [1]
    assert histogram(df.limit(0), "v", [], None, None, 5).count() == 0
