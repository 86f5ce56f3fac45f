"""Fill-in-middle against slices of Python strings."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from patronvoice.llm import middle


def slow(doc_id, text, seed="1"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in middle.MARKERS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, inside, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{inside}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{inside}"


TEXTS = [
    "", None, "a", "é", "日本語のテキスト", "🤦🏼‍♂️ mixed é text", "<", "<P", "P><S", "<P>in", "x<M>y", "<S>", "a<b>c<<p>>", "\x00\n\t ", "é" * 700,
]


def test_equals_slices(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no id"), (None, "no id"), (7, "again"), (7, "again"), (8, "long é" * 400_000)]
    found = middle.restore_middle(middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")) for r in found.collect()), key=repr)
    want = sorted(((i, *slow(i, t), t or "") for i, t in rows), key=repr)
    assert got == want and {r[2] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block,page,size", [(7, 8, 30), (64, 16, 1 << 20)])
def test_small_blocks(monkeypatch, block, page, size):
    """Texts that cross blocks, pages and slices; null-free arrays of all kinds of string."""
    monkeypatch.setattr(middle, "_BLOCK", block)
    monkeypatch.setattr(middle, "_PAGE", page)
    monkeypatch.setattr(middle, "_BYTES", size)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aé日🤦<S>P "), rng.integers(0, 60))) for _ in range(300)]
    texts = [t for t in texts if not any(m in t for m in middle.MARKERS)]
    low = np.array([rng.integers(0, len(t) + 1) for t in texts])
    high = np.array([rng.integers(a, len(t) + 1) for a, t in zip(low, texts)])
    form = rng.integers(0, 3, len(texts))
    for kind in (pa.string(), pa.large_string()):
        array = pa.array(["skipped", *texts], kind).slice(1)
        out = middle.scatter_texts(array, low, high, form)
        for t, a, b, f, o in zip(texts, low, high, form, out.to_pylist()):
            parts = t[:a], t[a:b], t[b:]
            assert o == [t, f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}", f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"][f]
        assert middle.gather_texts(out, form).to_pylist() == texts
    assert len(middle.scatter_texts(pa.array([], pa.string()), low[:0], low[:0], form[:0])) == 0
    assert len(middle.gather_texts(pa.array([], pa.string()), form[:0])) == 0


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", "x", 5, "keep")], "doc_id long, text string, output string, N int, _low string")
    got = middle.restore_middle(middle.fill_in_middle(df, rate=100, suffix_first=0, markers=("[a]", "[bb]", "[c]")), markers=("[a]", "[bb]", "[c]"))
    assert got.columns == ["doc_id", "text", "_low", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    row = got.first()
    assert row["n"] == 3 and row["form"] == "psm" and row["_low"] == "keep" and row["restored"] == "abc" and row["output"].startswith("[a]")
    assert middle.restore_middle(middle.fill_in_middle(df.limit(0))).collect() == []
    odd = spark.createDataFrame([(None, "plain"), ("as it is", None)], "output string, form string")
    assert {r["restored"] for r in middle.restore_middle(odd).collect()} == {"", "as it is"}
