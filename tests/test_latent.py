"""Latent vectors against numpy's SVD of the same table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronvoice.operators import latent
from patronvoice.operators.vectors import embed_texts

#: one direction per planted topic; the next singular value is far smaller, so these are well defined
DIMS = 7


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    words = [[f"w{t}x{i}" for i in range(25)] for t in range(DIMS)]
    common = [f"common{i}" for i in range(40)]
    rows = []
    for i in range(400):
        topic = words[min(int(rng.exponential(3)), DIMS - 1)]
        rows.append((i, " ".join([*rng.choice(topic, 12), *rng.choice(common, 8)])))
    rows += [(400, None), (401, ""), (402, "!! ? 7"), (403, rows[0][1])]
    return spark.createDataFrame(rows, "id int, text string").repartition(3)


def _dense(spark, df):
    """Unit TF-IDF rows by plain counting, with the word buckets of the model."""
    rows = sorted((r["id"], (r["text"] or "").lower().split()) for r in df.collect())
    vocabulary = sorted({w for _, ws in rows for w in ws if w.isalnum() and len(w) > 1})
    known = spark.createDataFrame([(w,) for w in vocabulary], "w string")
    bucket = {r["w"]: r["b"] for r in known.select("w", F.pmod(F.xxhash64("w"), F.lit(latent.FEATURES)).alias("b")).collect()}
    place = {b: i for i, b in enumerate(sorted(set(bucket.values())))}
    counts = np.zeros((len(rows), len(place)))
    for at, (_, ws) in enumerate(rows):
        for w in ws:
            if w in bucket:
                counts[at, place[bucket[w]]] += 1
    weights = counts * np.log((len(rows) + 1) / ((counts > 0).sum(axis=0) + 1))
    norms = np.linalg.norm(weights, axis=1, keepdims=True)
    return weights / np.where(norms > 0, norms, 1)


def _vectors(model, df):
    rows = model.transform(df, "text").select("id", "embedding").orderBy("id").collect()
    return np.array([r["embedding"] for r in rows])


def test_equals_the_svd_of_numpy(spark, texts):
    model = latent.fit_latent(texts, "text", DIMS)
    u, s, _ = np.linalg.svd(_dense(spark, texts), full_matrices=False)
    assert np.allclose(model.singular_values, s[:DIMS], rtol=1e-4)
    assert np.allclose(latent.fit_latent(texts, "text", 40).singular_values, s[:40], rtol=0.01)
    got = _vectors(model, texts)
    want = u[:, :DIMS] * s[:DIMS]
    norms = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.where(norms > 1e-9, want / np.maximum(norms, 1e-300), 0.0)
    # signs are free, so the cosines of all pairs are compared
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-3)
    assert not got[400:403].any()
    assert np.allclose(np.linalg.norm(np.delete(got, [400, 401, 402], axis=0), axis=1), 1.0)
    assert np.allclose(got[403], got[0], atol=1e-9)


def test_partitions_do_not_matter(texts):
    one, many = (latent.fit_latent(texts.repartition(n), "text", DIMS) for n in (1, 7))
    assert np.allclose(one.singular_values, many.singular_values, rtol=1e-9)
    assert np.allclose(_vectors(one, texts), _vectors(many, texts), atol=1e-6)


def test_words_of_one_context_meet(spark):
    """Two texts without a common word are near if other texts use their words together."""
    rows = [(i, "noodles soup broth bowl") for i in range(20)] + [(20 + i, "parking waiter bill queue") for i in range(20)]
    rows += [(40, "noodles soup"), (41, "broth bowl"), (42, "parking queue")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = _vectors(latent.fit_latent(df, "text", 2), df)
    assert got[40] @ got[41] > 0.99 and abs(got[40] @ got[42]) < 0.01
    hashed = {r["id"]: np.array(r["embedding"]) for r in embed_texts(df, "text", 1024).where("id >= 40").collect()}
    assert hashed[40] @ hashed[41] < 0.01


def test_edges(spark, texts):
    empty = latent.fit_latent(texts.limit(0), "text", DIMS)
    assert not empty.singular_values.any() and not _vectors(empty, texts).any()
    blank = texts.where("text IS NULL OR text = ''")
    assert not _vectors(latent.fit_latent(blank, "text", DIMS), blank).any()
    few = spark.createDataFrame([(1, "red green"), (2, "blue white " * 50_000)], "id int, text string")
    model = latent.fit_latent(few, "text", DIMS)  # a long text, and more directions than texts
    assert np.allclose(model.singular_values, [1, 1] + [0] * (DIMS - 2), atol=1e-6)
    clash = few.withColumns({"buckets": F.lit(1), "bucket": F.lit(2)})
    assert latent.fit_latent(clash, "text", 2).transform(clash, "text", "v").columns == ["id", "text", "buckets", "bucket", "v"]
    for bad in ({"features": 8}, {"dims": 4096}):
        with pytest.raises(ValueError):
            latent.fit_latent(few, "text", **bad)


def test_a_pass_has_as_many_tasks_as_cores(spark):
    """Each task hands on a block of its own, so their number must not grow with the files of the table."""
    cores = spark.sparkContext.defaultParallelism
    files = 3 * max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.createDataFrame([([i % 16], [1]) for i in range(8 * files)], "buckets array<int>, tf array<int>").repartition(files)
    spark.sparkContext.setJobGroup("a pass", "")
    try:
        got = latent._gram_times(rows, np.ones(16), np.eye(16)[:, :3])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert np.allclose(got[:3], np.eye(3) * (8 * files // 16)) and not got[3:].any()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("a pass") for s in tracker.getJobInfo(j).stageIds]
    assert 0 < max(s.numTasks for s in stages if s) < files
