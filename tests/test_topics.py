import math
from collections import Counter

import pytest
from patronvoice.operators import terms as terms_ops
from patronvoice.operators import topics as ops
from patronvoice.functions import truncate_for_model
from patronvoice.operators import vectors
from patronvoice.plans.topics import TopicParams, complaint_topics, fit_topics, negative_entity_reviews, run_topics, topic_map_2d
from pyspark.sql import functions as F

DOCS = [
    (0, "late delivery late"),
    (0, "Late delivery, again!"),
    (1, "cold food and the soup"),
    (1, "food was cold cold"),
    (1, "soup"),
    (2, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "topic_id long, text string").repartition(3)


def _grams(text, stop):
    words = [w.strip(",!") for w in text.lower().split()]
    words = [w for w in words if w not in stop]
    return words + [" ".join(p) for p in zip(words, words[1:])]


def test_term_counts_and_weights(docs):
    stop = ["and", "the", "was"]
    tf, df = Counter(), Counter()
    for topic, text in DOCS:
        grams = _grams(text, stop)
        tf.update((topic, g) for g in grams)
        df.update(set(grams))
    kept = {k: n for k, n in tf.items() if 2 <= df[k[1]] <= 0.5 * len(DOCS)}
    counts = terms_ops.term_counts(docs, "text", "topic_id", (1, 2), 2, 0.5, None, stop)
    assert {(r["topic_id"], r["term"]): r["tf"] for r in counts.collect()} == kept
    per_class, per_term = Counter(), Counter()
    for (topic, term), n in kept.items():
        per_class[topic] += n
        per_term[term] += n
    mean = sum(per_class.values()) / len(per_class)
    want = {k: n / per_class[k[0]] * math.log(1 + mean / per_term[k[1]]) for k, n in kept.items()}
    got = {(r["topic_id"], r["term"]): r["weight"] for r in terms_ops.class_tfidf(counts, "topic_id").collect()}
    assert got == pytest.approx(want)


def test_max_features_keeps_the_most_frequent(docs):
    got = terms_ops.term_counts(docs, "text", "topic_id", (1, 1), 1, 1.0, 2)
    assert {r["term"] for r in got.collect()} == {"cold", "late"}


def test_known_terms_match_exploded_terms(docs):
    known = ["late", "late delivery", "soup"]
    every = terms_ops.explode_terms(docs, "text", ["topic_id"]).where("first = 1").where(F.col("term").isin(known))
    some = terms_ops.explode_known_terms(docs, "text", ["topic_id"], known)
    assert sorted(some.collect()) == sorted(every.select("topic_id", "term").collect())


def test_stop_words(spark):
    assert "the" in terms_ops.stop_words() and "der" in terms_ops.stop_words(["german"])


def test_summary_labels_and_report(spark, docs):
    keywords = spark.createDataFrame([(0, ["late", "delivery"]), (1, ["zinc"])], "topic_id long, keywords array<string>").withColumn(
        "kw_weights", F.map_from_arrays("keywords", F.transform("keywords", lambda k: F.lit(0.5)))
    )
    data = docs.withColumn("topic_id", F.when(F.col("topic_id") == 2, -1).otherwise(F.col("topic_id")))
    topics = ops.topic_summary(data, keywords)
    rows = {r["topic_id"]: r for r in topics.collect()}
    assert (rows[0]["topic_label"], rows[0]["frequency"], rows[0]["pct"]) == ("Delivery & wait time", 2, 33.33)
    assert (rows[1]["topic_label"], rows[-1]["topic_label"]) == ("Zinc", "Uncategorised / noise")
    report = ops.topic_report(topics).first()
    assert (report["n_topics"], report["n_reviews_clustered"], report["noise_pct"]) == (2, 5, 16.67)
    assert [t["topic_id"] for t in report["topics"]] == [1, 0]
    labelled = ops.label_topics(spark.createDataFrame([(0,), (9,), (None,)], "topic_id long"), topics)
    assert sorted(r["topic_label"] for r in labelled.collect()) == ["Delivery & wait time", "unknown", "unknown"]
    assert ops.topics_for_export(topics).where("topic_id = 0").first()["keywords"] == "late, delivery"
    assert [r["topic_id"] for r in ops.sort_topics(topics).collect()] == [1, 0, -1]


def test_complaint_features(spark):
    rows = [("u1", 0, "A"), ("u1", 1, "B"), ("u1", 5, "B"), ("u1", 0, "A"), ("u1", -1, "noise"), ("u2", -1, "noise"), (None, 0, "A")]
    topics = spark.createDataFrame(rows, "url string, topic_id long, topic_label string")
    entities = spark.createDataFrame([("u1",), ("u2",), (None,)], "url string")
    got = {r["url"]: r for r in ops.map_topics_to_entities(entities, topics).collect()}
    assert (got["u1"]["dominant_complaint"], got["u1"]["complaint_diversity"], got["u1"]["complaint_review_count"]) == ("A", 2, 4)
    assert got["u1"]["complaint_topic_counts"] == {"A": 2, "B": 2}
    for key in ("u2", None):
        assert (got[key]["dominant_complaint"], got[key]["complaint_diversity"], got[key]["complaint_review_count"]) == (None, 0, 0)


def test_negative_selection_and_fallback(spark):
    rows = [("n", "negative", ["one two three four five", "too short"]), ("p", "positive", ["six words are in this one"])]
    df = spark.createDataFrame(rows, "url string, dominant_sentiment string, review_texts array<string>")
    assert [r["url"] for r in negative_entity_reviews(df).collect()] == ["n"]
    # the negative entity has no usable text left
    assert [r["url"] for r in negative_entity_reviews(df, min_tokens=6).collect()] == ["p"]
    assert negative_entity_reviews(df.drop("dominant_sentiment")).count() == 2
    with pytest.raises(ValueError):
        negative_entity_reviews(df, level="town")


@pytest.fixture(scope="module")
def planted(spark):
    themes = [
        "the delivery was late and the wait was long for us",
        "the staff was rude and the waiter ignored our table",
        "this dirty kitchen had a cockroach and a bad smell",
    ]
    rows = [(f"u{i % 10}", "negative", [f"{themes[i % 3]} again {w}" for w in ("today", "sadly")]) for i in range(90)]
    return spark.createDataFrame(rows, "url string, dominant_sentiment string, review_texts array<string>").withColumn(
        "url", F.concat("url", F.monotonically_increasing_id().cast("string"))
    )


@pytest.mark.parametrize("method", ["density", "kmeans"])
def test_planted_topics_are_found(planted, method):
    params = TopicParams(method=method, dims=2, eps=0.5, k=3, embed_dims=128, ngrams=(1, 1))
    entities, review_topics, topics = complaint_topics(planted, params)
    labels = {r["topic_label"]: r["frequency"] for r in topics.where("topic_id <> -1").collect()}
    assert labels == {"Delivery & wait time": 60, "Staff & service": 60, "Hygiene & cleanliness": 60}
    pairs = review_topics.select(F.substring("review_text", 1, 12), "topic_label").distinct().count()
    assert pairs == 3
    assert entities.where("complaint_review_count = 2 AND complaint_diversity = 1").count() == 90


def test_given_vectors_and_merge(spark):
    rows = [(i, f"word{i % 2} text", [1.0 if i % 2 else 0.0, 0.0 if i % 2 else 1.0, 0.001 * (i % 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "review_id long, review_text string, v array<double>")
    params = TopicParams(dims=2, eps=0.4, merge_tau=0.99, rerank=True)
    assigned, topics = fit_topics(df, params=params, vec_col="v")
    assert sorted(r["frequency"] for r in topics.collect()) == [30, 30]
    assert set(assigned.columns) == {"review_id", "review_text", "v", "topic_id", "topic_label"}


def test_topics_of_like_words_merge_by_average_link(spark):
    """Three groups of vectors, two of which are written in the same words."""
    words = ["cold soup food", "cold soup food", "late rider order"]
    vectors = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    rows = [(i, words[i % 3], [x + 0.001 * (i % 5) for x in vectors[i % 3]]) for i in range(90)]
    df = spark.createDataFrame(rows, "review_id long, review_text string, v array<double>")
    params = TopicParams(dims=2, eps=0.4, ngrams=(1, 1), merge_link="average", merge_count=2, rerank=False)
    assigned, topics = fit_topics(df, params=params, vec_col="v")
    assert sorted(r["frequency"] for r in topics.collect()) == [30, 60]
    assert assigned.select("review_text", "topic_id").distinct().count() == 2


def test_rerank_prefers_terms_close_to_the_topic(spark):
    rows = [(0, "late slow", [1.0, 0.0])] * 3 + [(0, "misc", [0.6, 0.8])] + [(1, "cold misc", [0.0, 1.0])] * 3
    docs = spark.createDataFrame(rows, "topic_id long, text string, vec array<double>")
    candidates = spark.createDataFrame([(0, "misc"), (0, "late")], "topic_id long, term string")
    for limit in (20_000, 0):
        ops.MAX_LITERAL_TERMS, kept = limit, ops.MAX_LITERAL_TERMS
        try:
            got = ops.rerank_keywords(candidates, docs, "text", "vec").orderBy("rank").collect()
        finally:
            ops.MAX_LITERAL_TERMS = kept
        assert [r["term"] for r in got] == ["late", "misc"]


def test_topic_map(spark):
    rows = [(i, i % 2, [float(i % 2), float(1 - i % 2), 0.01 * i]) for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, topic_id long, vec array<double>")
    points = topic_map_2d(docs, "id", "vec", n=12)
    assert sorted(r["id"] for r in points.collect()) == list(range(12))
    assert {r["topic_id"]: r["points"] for r in ops.topic_centroids_2d(points).collect()} == {0: 6, 1: 6}


def test_nothing_is_cut_by_default(spark):
    params = TopicParams()
    assert params.max_features is None and params.stop is None and params.merge_tau is not None
    text = spark.createDataFrame([("a" * 2000,)], "t string").select(truncate_for_model(F.col("t")).alias("t")).first()["t"]
    assert len(text) == 2000
    rows = spark.range(3100).select("id", (F.col("id") % 2).alias("topic_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0), F.lit(2.0)).alias("vec"))
    assert topic_map_2d(rows, "id", "vec").count() == 3100


def test_default_job_labels_planted_themes(planted):
    _, _, topics = complaint_topics(planted)
    labels = {r["topic_label"]: r["frequency"] for r in topics.where("topic_id <> -1").collect()}
    assert labels == {"Delivery & wait time": 60, "Staff & service": 60, "Hygiene & cleanliness": 60}


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "good food"), (2, None), (3, ""), (4, "good soup")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in vectors.embed_texts(df, "t", 16).collect()}
    assert not any(got[2]) and not any(got[3]) and any(got[1])
    assert vectors.embed_texts(df.limit(0), "t", 16).count() == 0
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id long, v array<double>")
    assert {r["id"] for r in vectors.reduce_dimensions(some, "v", 1).where("reduced IS NULL").collect()} == {2}
    assert vectors.reduce_dimensions(some.limit(0), "v", 1).count() == 0


def test_encoder_plugin(spark):
    def factory():
        return lambda texts: [[len(t), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    got = vectors.encode_batches(df, "t", factory)
    assert sorted(r["embedding"] for r in got.collect()) == [[0.0, 1.0], [2.0, 1.0]]


def test_run_topics(spark, planted, tmp_path):
    planted.write.parquet(str(tmp_path / "sentiment"))
    params = TopicParams(method="kmeans", dims=2, k=3, embed_dims=64, rerank=False)
    entities, topics = run_topics(spark, str(tmp_path / "sentiment"), str(tmp_path / "out"), params)
    assert entities.count() == 90 and topics.count() == 3
    assert spark.read.json(str(tmp_path / "out/topic_report")).first()["n_topics"] == 3


def test_terms_are_summed_before_rows_are_made(spark, monkeypatch):
    """Also across batches, with null topics and texts; few rows leave a batch of many texts."""
    rows = [(i % 3 or None, t) for i, t in enumerate(["aa bb aa bb", "bb", None, "aa bb cc", "", "cc aa bb aa", "bb"] * 30)]
    df = spark.createDataFrame(rows, "topic int, text string").repartition(1)
    want = {}
    for topic, text in rows:
        words = (text or "").split()
        grams = words + [" ".join(p) for p in zip(words, words[1:])]
        for g in grams:
            tf, docs = want.get((topic, g), (0, 0))
            want[topic, g] = tf + 1, docs
        for g in set(grams):
            want[topic, g] = want[topic, g][0], want[topic, g][1] + 1
    docs = {t: sum(d for (_, g), (_, d) in want.items() if g == t) for _, t in want}
    for words in (5, 1 << 20):
        monkeypatch.setattr(terms_ops, "WORDS", words)
        got = terms_ops.term_counts(df, "text", "topic", (1, 2), 40, 0.8)
        assert {(r["topic"], r["term"]): r["tf"] for r in got.collect()} == {k: tf for k, (tf, _) in want.items() if 40 <= docs[k[1]] <= 0.8 * len(rows)}
    assert terms_ops._summed_terms(df, "text", "topic", (1, 2), ()).count() == len(want)
