"""Mixing by source against a plain pass over sorted rows."""

import hashlib

import pytest
from patronvoice.llm import mix

_SCHEMA = "doc_id long, text string, source string"


def water(sizes, weights=(5, 2, 1), epochs=3, budget=None):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total = sum(sizes.values()) if budget is None else budget
    full = set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * rest > epochs * sizes[s] * open_weight}
        if not above:
            return {s: float(epochs * sizes[s]) if s in full else weight[s] * rest / open_weight for s in order}
        full |= above


def plain(rows, **options):
    key = lambda i, t: hashlib.sha256(f"mix:{i if i is not None else hashlib.sha256((t or '').encode()).hexdigest()}".encode()).hexdigest()
    size = lambda t: len((t or "").encode().split())
    by = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((key(i, t), size(t), i))
    sizes = {s: sum(r[1] for r in own) for s, own in by.items()}
    target = water(sizes, **options)
    out = []
    for s, own in by.items():
        goal = int(target[s])
        passes = goal // sizes[s] if sizes[s] else 0
        left = goal - passes * sizes[s]
        for _, n, i in sorted(own, key=lambda r: r[:2]):
            part = min(n, left)
            left -= part
            out.append((i, n, sizes[s], target[s], passes * n + part))
    return out


def _rows():
    rows = [(i, f"w{i} " * (i % 7), "hot" if i % 3 else "b") for i in range(400)]
    rows += [(1000 + i, "one word two", None) for i in range(20)] + [(2000, "tiny", "Z"), (2001, "tiny", "é"), (2002, None, "none"), (2003, " \t\n", "none")]
    return rows + [(None, "no id", "hot"), (None, "other", "hot"), (5, "a a", "hot"), (5, "a a", "hot"), (9000, "long " * 50_000, "a")]


def _got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts,options", [(1, {}), (7, {}), (3, {"weights": (1, 9), "epochs": 2}), (3, {"budget": 100}), (2, {"epochs": 1})])
def test_equals_plain_pass(spark, parts, options):
    rows = _rows()
    found = mix.mix_sources(spark.createDataFrame(rows, _SCHEMA).repartition(parts), **options)
    got = _got(found)
    assert got == sorted(plain(rows, **options), key=repr)
    per = {}
    for r in found.collect():
        assert 0 <= r["taken"] <= options.get("epochs", 3) * r["size"]
        per.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(taken == int(target) for taken, target in per.values()) and None in per


def test_many_sources_share_again(spark):
    """Limits are met one after the other, in several rounds."""
    rows = [(i, "w " * (1 + 40 * (i == 11) + i), f"s{i:02d}") for i in range(12)]
    assert _got(mix.mix_sources(spark.createDataFrame(rows, _SCHEMA))) == sorted(plain(rows), key=repr)


def test_documents_of_the_mix(spark):
    rows = [(i, t, s, i) for i, t, s in _rows()]
    df = spark.createDataFrame(rows, _SCHEMA + ", Epoch int")
    found = mix.mixed_documents(df)
    assert found.columns == ["doc_id", "text", "source", "epoch"]
    words = {}
    for r in found.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").encode().split())
        assert r["epoch"] < 3
    want = {}
    for r in mix.mix_sources(df).collect():
        want[r["source"]] = int(r["target"])
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in want.items() if n}
    again = mix.mixed_documents(df.repartition(5)).groupBy("source", "epoch").count().collect()
    assert sorted(again, key=repr) == sorted(found.groupBy("source", "epoch").count().collect(), key=repr)


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], _SCHEMA)
    assert _got(mix.mix_sources(df)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mix.mix_sources(df.limit(0)).collect() == [] and mix.mixed_documents(df.limit(0)).collect() == []
