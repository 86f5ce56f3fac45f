"""Near-duplicates of texts and vectors against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest
from patronvoice.llm import epsilon, simhash, similar
from patronvoice.llm.common import components
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

DOCS = "doc_id bigint, text string, id string, fp string, component_id string, k string"


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    want = classes(1200, edges)
    assert got == {i: want[i] for i in {x for e in edges if e[0] != e[1] for x in e}}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    codes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes)) if codes else 0


def test_fingerprints(monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "One two", "É a  b\tC\x0bd\x85e"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 90))) for _ in range(60)]
    want = [slow_fingerprint(t) for t in texts]
    assert simhash.fingerprint_values(texts).tolist() == want
    monkeypatch.setattr(simhash, "_BATCH", 20)  # long texts, part by part
    assert simhash.fingerprint_values(texts).tolist() == want


def planted(seed, groups=12, size=40, spread=3):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            value = centre
            for b in rng.sample(range(64), rng.randint(0, spread)):
                value ^= 1 << b
            out.append(value)
    return sorted(set(out))


@pytest.mark.parametrize("crowded", [2, 64])
def test_links_are_complete(spark, crowded):
    values = planted(crowded)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v, 0) for v in signed], "fp bigint, first bigint"), crowded=crowded)
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and got.count() == len(want) > 100


@pytest.mark.parametrize("thresholds", [[0, 0, 0], [1, 0], [2]])
def test_any_allocation_is_complete(spark, monkeypatch, thresholds):
    size = -(-64 // len(thresholds))
    groups = [(simhash._mask(range(i * size, min(64, i * size + size))), t) for i, t in enumerate(thresholds)]
    monkeypatch.setattr(simhash, "plan", lambda *_: groups)
    values = planted(9, groups=5)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = simhash.links(spark.createDataFrame([(v, 0) for v in signed], "fp bigint, first bigint"), crowded=4)
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in got.collect()} == want


@pytest.mark.parametrize("thresholds", [[0, 1], [1, 0]])
def test_a_hot_group_is_split_where_it_is_probed(spark, monkeypatch, thresholds):
    low, high = (1 << 32) - 1, (1 << 64) - (1 << 32)
    groups = list(zip([low, high], thresholds))
    monkeypatch.setattr(simhash, "plan", lambda *_: groups)
    rng = np.random.default_rng(4)
    # 10,000 prints in one bucket of the low bits, some of them moved by one bit there, and near ones among them
    base = rng.integers(0, 1 << 32, 9_000, dtype=np.uint64) << np.uint64(32) | np.uint64(12345)
    moved = base[:1_000] ^ (np.uint64(1) << rng.integers(0, 64, 1_000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1_000, dtype=np.uint64))
    prints = np.unique(np.concatenate([base, moved]))
    signed = prints.view(np.int64)
    want = set()
    for at in range(0, len(prints), 500):
        close = np.bitwise_count(prints[at : at + 500, None] ^ prints[None, :]) <= simhash.DISTANCE
        want |= {tuple(sorted((int(signed[at + i]), int(signed[j])))) for i, j in np.argwhere(close) if at + i != j}
    got = simhash.links(spark.createDataFrame([(int(v), 0) for v in signed], "fp bigint, first bigint"))
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) >= 950


def test_allocation_is_the_cheapest():
    assert simhash.allocate([[9, 20, 90], [9, 20, 90], [9, 20, 90]], 3) == [0, 0, 0]
    assert simhash.allocate([[1, 2, 3], [50, 60, 90], [70, 80, 90]], 3) == [2, -1, -1]
    assert simhash.allocate([[5, 6, 90], [5, 60, 90], [50, 80, 90]], 3) == [1, 0, -1]


def test_near_duplicates_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base + " end"), (None, base), (7, "other text here"), (7, "other text here"), (8, None), (2, ""), (1, "  ")]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "k") for i, t in rows], DOCS)
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["doc_id"] is not None)
    far = bin(slow_fingerprint(base) ^ slow_fingerprint(base + " end")).count("1")
    assert got == [(1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (7, 7), (8, 1), (9, 3 if far <= 2 else 9)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == sorted([0, 1, 3, 7] + ([] if far <= 2 else [9]))
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_texts_without_an_id_of_their_own_are_compared(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(4, a), (4, b), (2, a), (4, a), (None, a), (None, c), (None, c + " end"), (None, c), (None, None), (6, ""), (7, b + " end"), (4, b)]
    df = spark.createDataFrame([(i, t, "x", "y", "z", "k") for i, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    found = {(r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()}
    assert found == {(2, "a"), (4, "b"), (None, "c"), (6, "")} and kept.count() == 4
    # a text is not lost with the id that it shares
    kept = simhash.keep_one(df.where("doc_id <= 4")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(2, a), (4, b)]


VECTORS = "vec_id bigint, embedding array<float>, label int, node string, n string"


def slow_vectors(rows, t):
    usable = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = []
    for i in usable:
        for j in usable:
            a, b = (np.float32(rows[k][1]).astype(float) for k in (i, j))
            if i < j and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                linked.append((i, j))
    roots = classes(len(rows), linked)
    links = [sum(i in pair for pair in linked) for i in range(len(rows))]
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in roots}
    return sorted((rows[i][0], links[i], least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))


@pytest.mark.parametrize("block", [4, 128])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(8):
            centre = rng.standard_normal(8)
            rows += [(len(rows) + k, (centre + 0.09 * rng.standard_normal(8)).tolist(), label) for k in range(12)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(9)] + [(1100, [2 * x for x in rows[3][1]], 0), (1101, rows[0][1], 1)]
    rows += [(1200, None, 0), (1201, [0.0] * 8, 0), (1202, [None] + [1.0] * 7, 0), (1203, [float("nan")] * 8, 0), (1204, [float("inf")] * 8, 0)]
    rows += [(1205, rows[0][1], None), (1206, [1.0, 0.0], 0), (1207, [1.0, 0.01], 0), (1208, [], 0), (5, rows[5][1], 0)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS).repartition(4)
    got = sorted(tuple(r) for r in epsilon.near_vectors(df, block=block).collect())
    assert got == slow_vectors(rows, 0.98)


def test_near_vectors_of_nothing(spark):
    assert epsilon.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    got = epsilon.near_vectors(spark.createDataFrame([(3, None, None, "a", "b"), (None, [1.0], 1, "a", "b")], VECTORS)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["kept"]) for r in got) == [(-1, 0, True), (3, 0, True)]


def test_distant_blocks_are_skipped(spark):
    heads = [("a", i, [float(i)], [float(i) + 0.5]) for i in range(40)]
    df = spark.createDataFrame([(1, leaf, lo, hi) for _, leaf, lo, hi in heads], "label bigint, leaf bigint, lo array<double>, hi array<double>")
    got = {(r["a"], r["b"]) for r in epsilon.block_pairs(df, 0.6, 1, 40).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i, 40) if j - i <= 1}


def word_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_similarity(x, y):
    return similarity(word_shingles(x), word_shingles(y))


@pytest.mark.parametrize("sample", [{}, {"sample_rows": 10, "limit": 5}])
def test_similar_texts_find_changed_copies(spark, sample):
    rng = random.Random(17)
    texts = [None, "", " \n", "one two", "One  two", "one two three", " ".join("same words again and again".split() * 9)]
    for size in (12, 40, 90, 400):
        for changed in (0.0, 0.01, 0.02, 0.04, 0.1):
            base = [f"w{rng.randint(0, 900)}" for _ in range(size)]
            for _ in range(4):
                words = list(base)
                at = rng.randrange(size)  # one run of changed words, or single ones
                for i in range(round(changed * size)) if changed > 0.03 else ():
                    words[(at + i) % size] = f"x{rng.randint(0, 900)}"
                for i in rng.sample(range(size), round(changed * size)) if changed <= 0.03 else ():
                    words[i] = f"x{rng.randint(0, 900)}"
                texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if slow_similarity(texts[i], texts[j]) >= 0.8]
    roots = classes(len(texts), want)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = similar.similar_texts(df, **sample)
    assert [r["component_id"] for r in got.orderBy("doc_id").collect()] == roots
    prints = [slow_fingerprint(t) for t in texts]
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in want) > 10  # what the fingerprints' bound loses
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == set(roots)
    assert similar.similar_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("crowded,sample", [(16, {"limit": 1}), (2048, {"limit": 1}), (2048, {})])
def test_a_passage_in_half_of_all_texts(spark, monkeypatch, crowded, sample):
    """Its shingles are crowded where the sample does not tell of them; nothing is lost and nothing else is linked."""
    monkeypatch.setattr(similar, "CROWDED", crowded)
    rng = random.Random(23)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for i in range(300):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(20, 160))]
        texts.append(" ".join(own[:10] + [passage] * (i % 2) + own[10:]))
    for i in range(0, 120, 3):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += [passage] * 20 + [passage + " end", "start " + passage]
    sets = [word_shingles(t) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = similar.similar_texts(df, **sample).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == classes(len(texts), want)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for size in (3, 100, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for changed in (0, 1, size // 10, size):
            b = np.unique(np.append(a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)))
            apart = sum(int(x).bit_count() for x in (similar.parity_bits(a) ^ similar.parity_bits(b)).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b))
    wide, half = similar.parity_bits(a, 16), similar.parity_bits(a, 8)
    assert (wide[:8] ^ wide[8:] == half).all()


def test_a_pair_is_made_where_its_common_shingles_begin(spark, monkeypatch):
    """Every pair that the shingles give is made, but not once for each shingle of a common run."""
    rng = random.Random(31)
    runs = [rng.sample(range(10_000 * i, 10_000 * i + 10_000), 60) for i in range(6)]
    sets = [sorted(x for run in rng.sample(runs, 2) for x in run if rng.random() < 0.9) for _ in range(30)]
    rows = [(code, node, len(found), at, node, *[0] * similar._WIDTH) for node, found in enumerate(sets) for at, code in enumerate(found)]
    placed = spark.createDataFrame(rows, "code bigint, node bigint, n int, at int, component bigint, " + ", ".join(f"{b} bigint" for b in similar._BITS))
    placed = placed.join(placed.groupBy("code").agg(F.count("*").alias("nodes")), "code")
    fits = lambda a, b, i, j: min(len(a) - i, len(b) - j) >= 4 / 9 * (len(a) + len(b)) - 1e-9
    place = [{code: at for at, code in enumerate(found)} for found in sets]
    want = [
        (x, y)
        for x in range(len(sets))
        for y in range(x + 1, len(sets))
        for code in place[x].keys() & place[y].keys()
        if fits(sets[x], sets[y], place[x][code], place[y][code])
    ]
    assert {tuple(r) for r in similar._met(placed, 0.8).collect()} == set(want)
    monkeypatch.setattr(type(placed), "distinct", lambda df: df)
    assert len(set(want)) <= similar._met(placed, 0.8).count() < len(want) / 5
