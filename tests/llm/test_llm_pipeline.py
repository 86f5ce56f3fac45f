"""The pipeline's stages, and the queries with SQL on the small driver tables."""

import os

import corpus_pipeline
import oracle
import pytest
from patronvoice.llm import quality
from patronvoice.llm.common import table
from patronvoice.llm.queries import ORACLE, QUERIES
from test_llm_dedup import similarity, word_shingles
from test_llm_text import slow_contamination

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
oracle.TYPES["BOOLEAN"] = "boolean"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) is None


def test_registered():
    import __spark_entry__ as driver

    names = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in driver.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]


def test_stages_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, rows = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    stats, model = quality.quality_model(docs, table(spark, FOLDER, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(stats, model).collect()}
    good = stages["quality"](spark, docs, FOLDER)
    want = [r for r in rows if scores[r["doc_id"]] >= quality.THRESHOLD]
    assert good.columns == columns and sorted(good.collect()) == sorted(want) and len(want) < len(rows)

    sets = {r["doc_id"]: word_shingles(r["text"]) for r in want}
    root = {i: i for i in sets}
    for a in sets:  # components over all pairs
        for b in sets:
            if a < b and similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if c == old else c for i, c in root.items()}
    assert any(root[i] != i for i in root)
    single = [r for r in want if root[r["doc_id"]] == r["doc_id"]]
    apart = stages["near_duplicates"](spark, spark.createDataFrame(want, docs.schema), FOLDER)
    assert apart.columns == columns and sorted(apart.collect()) == sorted(single)

    items = [(r["item_id"], r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = [r for r in single if not slow_contamination(r["text"], items)[1]]
    left = stages["decontamination"](spark, spark.createDataFrame(single, docs.schema), FOLDER)
    assert left.columns == columns and sorted(left.collect()) == sorted(clean)

    packed = {r["doc_id"] for r in stages["packing"](spark, spark.createDataFrame(clean, docs.schema), FOLDER).select("doc_id").collect()}
    assert packed == {r["doc_id"] for r in clean}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").collect()} == packed
