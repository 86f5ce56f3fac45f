"""The trigram index finds what the scan finds and opens fewer files."""

import re

import pytest
from pyspark.sql import functions as F

from patronvoice.operators.search import search_hits
from patronvoice.operators.search_index import build_search_index, open_search_index, required_texts
from patronvoice.sources.synthetic import synthesize_reviews


@pytest.fixture(scope="module")
def reviews(spark):
    odd = [
        (9001, "Ask the \u212aitchen for a re\u017ferved seat", "a", "negative"),
        (9002, "ISTANBUL k\u0131tchen a.b|c (half) [price]", "b", "positive"),
        (9003, None, None, None),
        (9004, "", "a", None),
        (9005, "quaint\nplace xyz " * 20_000, "a", "positive"),
        (9005, "quaint\nplace xyz " * 20_000, "a", "positive"),
    ]
    made = synthesize_reviews(spark, 600).select(F.monotonically_increasing_id().alias("id"), "review_text", "topic_label", "sentiment")
    return made.union(spark.createDataFrame(odd, "id long, review_text string, topic_label string, sentiment string")).withColumn("_file", F.lit(7)).persist()


@pytest.fixture(scope="module")
def index(reviews, tmp_path_factory):
    return build_search_index(reviews, str(tmp_path_factory.mktemp("index") / "i"), rows_per_file=12)


REGEX = [
    "kitchen", "reserved", "istan(bul)?", "rider turned up|half an hour", "hair|.", "colo?d", "quaint.place", "quaint\\splace",
    "wait(ed)? for", "[a-c]old food", "xyz{2}", "xyz+ quai", "(?:half|full) an hour", "a\\.b", "\\bhair\\b", "zzzz", "", "(?=hair)hair", "[^]]air",
]


@pytest.mark.parametrize("mode,query", [("regex", q) for q in REGEX] + [("literal", q) for q in ["a.b|c (half)", "[price]", "(", "hair", "\u212aitchen"]])
def test_same_rows_as_the_scan(reviews, index, mode, query):
    assert sorted(index.hits(query, mode=mode).collect(), key=str) == sorted(search_hits(reviews, query, mode=mode).collect(), key=str)


def test_facets_and_fewer_files(spark, reviews, index):
    got = index.hits("half an hour", sentiment="negative", topic="Delivery & wait time")
    assert got.count() == search_hits(reviews, "half an hour", "Delivery & wait time", "negative").count() > 0
    rare = index.read_report("istanbul").first()
    assert rare["files"] == index.files > 40 and rare["files_read"] == 1
    none, every = index.read_report("zzzz").first(), index.read_report("ab").first()
    assert none["files_read"] == 0 and every["files_read"] == index.files
    found = index.hits("istanbul")
    assert found.columns == reviews.columns
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_reopened_and_empty(spark, reviews, index, tmp_path):
    small = reviews.where("id >= 9000").drop("_file")
    build_search_index(small, str(tmp_path / "a"), rows_per_file=2)
    again = open_search_index(spark, str(tmp_path / "a"), small.withColumn("_file", F.lit(0)))
    assert [r["id"] for r in again.hits("istanbul").collect()] == [9002]
    nothing = build_search_index(small.limit(0), str(tmp_path / "b"))
    assert nothing.hits("istanbul").count() == 0 and nothing.hits().count() == 0


@pytest.mark.parametrize(
    "query,want",
    [("there", [["there"]]), ("a|there", [[], ["there"]]), ("ther(ou|in)", [["ther"]]), ("thers?e", [["ther"]]), ("abcd{0,2}ef g", [["abc", "ef g"]]),
     ("a\\|bcd", [["bcd"]]), ("\\Qabc", None), ("(?x)a bc", None), ("(abc", None), ("[a[bc]]def", None)],
)
def test_required_texts(query, want):
    assert required_texts(query) == want
    assert required_texts("X" + re.escape("a.b") + "cde", "regex") == [["bcde"]]
