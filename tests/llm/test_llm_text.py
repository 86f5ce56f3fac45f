"""Quality, URLs, decontamination, shards and pages against brute force and planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from patronvoice.llm import decontaminate as dec
from patronvoice.llm import quality, shards, sitetree, urlfilter
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, row string, size int, _stats int, block int, spans string, text_sha256 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "r", 1, 2, 3, "s", "d") for i, t in rows], DOCS)


# --- quality


def prose(rng, bad):
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(1, 8))) for _ in range(rng.randint(5, 60))]
    if bad:
        return rng.choice(["!! ", " | ", "*** "]).join(w.upper() for w in words)
    return " ".join(words).capitalize() + "."


def test_quality_held_out(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, i % 4 == 0)) for i in range(900)]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows if i % 3] + [(1, None), (None, 1), (-5, 0)], "doc_id bigint, quality int")
    stats, model = quality.quality_model(df, labels)
    got = quality.score_quality(stats, model).select("doc_id", "score", quality.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["out"]]
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in out]) > 0.97
    kept = quality.keep_good(df, labels)
    assert kept.columns == [c for c in df.columns if c != "_stats"] or kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["score"] >= 0.3}


def test_quality_equals_a_plain_fit(spark):
    """All rows in one array: ridge by least squares, the isotonic shares by their min-max formula."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.random() < 0.4)) for i in range(500)]
    good = {i: int((t[-1] == ".") != (rng.random() < 0.15)) for i, t in rows}
    labels = spark.createDataFrame(sorted(good.items()), "doc_id bigint, quality int")
    df = docs(spark, rows).repartition(7)
    stats, model = quality.quality_model(df, labels)

    seen = [i for i in good if zlib.crc32(str(i).encode()) % 5]
    x = quality.text_statistics([t for _, t in rows])
    y = np.array([good[i] for i in seen], dtype=float)
    mean, spread = x[seen].mean(axis=0), x[seen].std(axis=0)
    draw = np.random.default_rng(quality.SEED)
    slopes = draw.standard_normal((x.shape[1], quality.FEATURES)) / (quality.WIDTH * np.sqrt(x.shape[1]))
    shifts = draw.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((x - mean) / np.where(spread < 1e-9, 1.0, spread), -8, 8)
    phi = np.c_[np.sqrt(2 / quality.FEATURES) * np.cos(z @ slopes + shifts), np.ones(len(z))]
    bend = np.sqrt(len(seen) * quality.RIDGE / quality.FEATURES) * np.eye(quality.FEATURES + 1)[:-1]
    weights = np.linalg.lstsq(np.r_[phi[seen], bend], np.r_[y, np.zeros(len(bend))], rcond=None)[0]
    raw = phi @ weights
    assert np.allclose(model.raw(x), raw, atol=1e-4)

    bins = np.clip(((raw[seen] + 0.5) / 2 * quality._BINS).astype(int), 0, quality._BINS - 1)
    at = np.unique(bins)
    n, hits = (np.array([w[bins == b].sum() for b in at]) for w in (np.ones(len(y)), y))
    share = lambda i, j: hits[i : j + 1].sum() / n[i : j + 1].sum()
    shares = [max(min(share(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    want = np.interp(raw, [raw[seen][bins == b].mean() for b in at], shares)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(stats, model).collect()}
    # a row whose raw score lies on the edge of a bin may fall to either side
    assert np.mean(np.abs(np.array([got[i] for i, _ in rows]) - want) < 0.01) > 0.99


def test_quality_does_not_see_held_out_labels(spark):
    rng = random.Random(2)
    df = docs(spark, [(i, prose(rng, i % 2)) for i in range(200)])
    out = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(200)]
    some = lambda turned: spark.createDataFrame([(i, (i + (turned and out[i])) % 2) for i in range(200)], "doc_id bigint, quality int")
    scores = [[r["score"] for r in quality.score_quality(*quality.quality_model(df, some(t))).orderBy("doc_id").collect()] for t in (False, True)]
    assert scores[0] == scores[1]


def test_quality_odd_tables(spark):
    df = docs(spark, [(1, None), (1, ""), (None, "x " * 100_000), (4, "\n")])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r["score"] for r in quality.score_quality(*quality.quality_model(df, none)).collect()] == [0.5] * 4
    ones = spark.createDataFrame([(4, 1)], "doc_id bigint, quality int")
    assert quality.keep_good(df, ones).count() == 4
    assert quality.keep_good(docs(spark, []), ones).count() == 0


def test_statistics_do_not_depend_on_batches(monkeypatch):
    texts = [None, "", "Aa b!|é\n9 9", "x" * 50, "THE END"] * 3
    want = quality.text_statistics(texts)
    monkeypatch.setattr(quality, "_CHUNK", 7)
    assert np.allclose(quality.text_statistics(texts), want)


def test_isotonic():
    assert quality._isotonic(np.array([0.0, 1, 0, 1, 1]), np.array([1.0, 1, 1, 1, 2])).tolist() == [0, 0.5, 0.5, 1, 1]


# --- URLs


URLS = {
    "https://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://a.example.com/en/": ("a.example.com", "/en/", "example.com/en/", "block"),
    "http://badexample.com/en/": ("badexample.com", "/en/", "com/", "allow"),
    "http://example.com": ("example.com", "", None, "allow"),
    "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"),
    "http://net/fr/": ("net", "/fr/", "net/fr/", "block"),
    "http://x.org?a/b": ("x.org", "", None, "allow"),
    "a://b://c/d": ("b:", "//c/d", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(1, u, "h", "t", "r") for u in [*URLS, "http://x.net/es/1"]], "page_id bigint, url string, host string, token string, row string")
    none = spark.createDataFrame([], "tokens array<string>, blocked boolean")
    got = urlfilter.judge_urls(pages, none).collect()
    found = sorted((r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got)
    assert found == sorted((h, p, r or "", v) for h, p, r, v in [*URLS.values(), URLS["http://x.net/es/1"]])
    assert urlfilter.judge_urls(pages.limit(0), none).count() == 0


def test_rules_are_mined_and_matched(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        host = rng.choice(["casino", "news", "blog"]) + "." + rng.choice(["win", "site"]) + ".org"
        path = rng.choice(["/slots/", "/a/", "/b/"]) + str(i)
        rows.append((f"http://{host}{path}", host.startswith("casino.win") or (host.startswith("blog") and path.startswith("/slots"))))
    both = spark.createDataFrame(rows, "url string, blocked boolean")
    labelled = both.select(urlfilter.url_tokens(urlfilter.url_host(F.col("url")), urlfilter.url_path(F.col("url"))).alias("tokens"), "blocked")
    labelled = labelled.union(spark.createDataFrame([(None, True), (["h=x"], None)], "tokens array<string>, blocked boolean"))
    rules = [tuple(r["tokens"]) for r in urlfilter.mine_rules(labelled, min_confidence=0.9).collect()]
    sets = [set(r) for r in rules]
    assert {"h=casino", "h=win"} in sets and {"h=blog", "p=slots"} in sets and {"h=news"} not in sets
    pages = both.select(F.monotonically_increasing_id().alias("page_id"), "url", "blocked")
    got = urlfilter.judge_urls(pages, labelled, min_confidence=0.9).join(pages, "page_id")
    assert all((r["verdict"] == "block") == r["blocked"] and r["rule"] is None for r in got.collect())
    # matching by the index is matching by every rule
    some = {frozenset(r) for r in rules}
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", urlfilter.url_tokens(urlfilter.url_host(F.col("url")), urlfilter.url_path(F.col("url"))).alias("t")).collect()}
    assert all((r["confidence"] is not None) == any(s <= tokens[r["page_id"]] for s in some) for r in got.collect())


def test_rules_do_not_depend_on_how_many_urls_are_labelled(spark):
    """A rare token that always goes with a block is a rule in a large table, and where most URLs are blocked."""
    rng = random.Random(5)
    for n, share in ((600, 0.1), (30_000, 0.1), (30_000, 0.8)):
        rows = [(["h=org", f"p=t{rng.randrange(5)}"], rng.random() < share) for _ in range(n)]
        rows += [(["h=org", "p=slots"], True)] * 80
        labelled = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
        rules = {tuple(r["tokens"]) for r in urlfilter.mine_rules(labelled).collect()}
        assert rules == {("p=slots",), ("h=org", "p=slots")}
        pages = spark.createDataFrame([(1, "http://org/slots"), (2, "http://org/t1"), (3, "http://net/es/t1")], "page_id bigint, url string")
        assert {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "block"}
    same = spark.createDataFrame([(["h=org"], True)] * 50, "tokens array<string>, blocked boolean")
    assert urlfilter.mine_rules(same).count() == 0


# --- decontamination


def slow_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_contamination(text, items):
    words, hit, found = slow_words(text), set(), set()
    for name, item in items:
        own = slow_words(item)
        n = min(10, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit |= set(range(i, i + n))
                    found.add("" if name is None else str(name))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("bound", [dec.BROADCAST_BYTES, 0])
def test_contamination(spark, monkeypatch, bound):
    monkeypatch.setattr(dec, "BROADCAST_BYTES", bound)
    rng = random.Random(4)
    vocabulary = ["The", "of", "É", "x1", "and", "ß"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(9, 16)))) for i in range(6)]
    items += [(10, "short one"), (11, ""), (12, None), (None, "null item"), (10, "other text of the same id"), (13, " ".join(items[0][1].split()[:12]))]
    rows = [(i, " ".join(rng.choices(vocabulary, k=40)) + ", " + (rng.choice(items)[1] or "").upper() if i % 2 else " ".join(rng.choices(vocabulary, k=30))) for i in range(40) if i not in (11, 12)]
    rows = [(i, t) for i, t in rows if t] + [(50, None), (51, ""), (52, "SHORT-one short"), (52, "SHORT-one short"), (None, "null item"), (53, "a NULL item short one other")]
    bench = spark.createDataFrame([(i, t, 1, "w") for i, t in items if t is None or t], "item_id bigint, text string, code int, win string")
    df = docs(spark, rows)
    want = sorted((str(i), n, str(h), str(f)) for i, t in rows for n, h, f in [slow_contamination(t, items)])
    spread = lambda spans: sorted({p for s in spans for p in range(s["at"] - 1, s["at"] - 1 + s["length"])})
    got = dec.contamination(df, bench).withColumn("n_hit", dec.covered_words(F.col("spans"))).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], str(spread(r["spans"])), str(r["items"])) for r in got) == want
    assert all(r["n_hit"] == len(spread(r["spans"])) for r in got)
    clean = dec.decontaminate(df, bench)
    assert clean.columns == df.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(t) for _, t in rows if not slow_contamination(t, items)[1])
    cut = dec.decontaminate(df, bench, remove="spans")
    left = sorted(slow_words(r["text"]) for r in cut.collect())
    assert left == sorted([w for k, w in enumerate(slow_words(t)) if k not in slow_contamination(t, items)[1]] for _, t in rows)
    assert [r["n_words"] for r in dec.contamination(df, bench.limit(0)).where("size(spans) > 0").collect()] == []
    assert dec.contamination(docs(spark, []), bench).count() == 0


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_BYTES", 0)
    long = " ".join(f"w{i % 977}" for i in range(150_000)) + " one two"  # 150,002 words
    df = docs(spark, [(i, f"{i} one two three") for i in range(50)] + [(60, long), (61, long)])
    bench = spark.createDataFrame([("a", "one two"), ("b", "7 one"), ("c", "w5 w6 w7")], "item_id string, text string")
    found = dec.contamination(df, bench).withColumn("n_hit", dec.covered_words(F.col("spans"))).collect()
    got = {r["doc_id"]: (r["items"], r["n_words"], r["n_hit"]) for r in found}
    want = {i: (["a", "b"], 4, 3) if i == 7 else (["a"], 4, 2) for i in range(50)}
    hits = 3 * sum(1 for i in range(150_000) if i % 977 == 5 and i + 2 < 150_000) + 2
    assert got == {**want, 60: (["a", "c"], 150_002, hits), 61: (["a", "c"], 150_002, hits)}


def test_windows_of_one_code_are_told_apart(spark, monkeypatch):
    """Both ways compare the words of a window, not only its code."""
    monkeypatch.setattr(dec, "_codes", lambda words: F.transform(words, lambda w: F.lit(1)))
    df = docs(spark, [(1, "one two"), (2, "two three"), (3, "four five"), (4, None)])
    bench = spark.createDataFrame([("a", "one two"), ("b", "two three")], "item_id string, text string")
    for bound in (dec.BROADCAST_BYTES, 0):
        monkeypatch.setattr(dec, "BROADCAST_BYTES", bound)
        assert {r["doc_id"]: r["items"] for r in dec.contamination(df, bench).collect()} == {1: ["a"], 2: ["b"], 3: [], 4: []}


# --- shards


@pytest.mark.parametrize("block_bytes", [1 << 26, 300])
def test_shards(spark, block_bytes):
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot text"] * 3 + ["x" * rng.randint(0, 60)])) for i in range(3000)] + [(None, None), (1, ""), (1, "")]
    df = docs(spark, rows).repartition(5)
    got = shards.shard_by_bytes(df, block_bytes=block_bytes).toPandas()
    assert len(got) == len(rows) and (got["size"] == got.text.fillna("").str.len() + 1).all()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * 62
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert shards.shard_by_bytes(docs(spark, [])).count() == 0
    again = shards.shard_by_bytes(df.repartition(3), block_bytes=block_bytes).toPandas()
    key = ["shard", "slot", "text"]
    assert got[key].sort_values(key[:2]).reset_index(drop=True).equals(again[key].sort_values(key[:2]).reset_index(drop=True))


def test_shards_of_one_huge_text(spark):
    got = shards.shard_by_bytes(docs(spark, [(1, "y" * 5000), (2, "a"), (3, None)])).toPandas()
    assert len(got) == 3 and got.shard.between(0, 15).all() and not got.duplicated(["shard", "slot"]).any()


# --- pages


CASES = {
    "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>A</h1><p>b<b>c</b>\n d&nbsp;&lt;e&gt;<br><p>f &amp g</article><footer>x": "A bc d <e> f & g",
    "<body><div class='ad-box'>buy</div><main><p>one<div id=comments>no</div><ul><li>two<li>three</ul></main><aside>no</aside>": "one two three",
    "<p>plain <span class=cookie-notice>no</span> text<!-- no --><script>if (a < b) '</p>'</script><style>p{}</style>": "plain text",
    "<article><header><h1>T</h1></header><form>no</form><table><tr><td>q<td>r</table><p>x < y": "T q r x < y",
    "<div hidden>no</div><div role=navigation>no</div><p>yes</p></b></p><p": "yes",
    "no markup &eacute; &#233;&#x41;": "no markup é éA",
    "": "",
    None: "",
    "<nav>only</nav>": "",
    "<script>never closed": "",
}


@pytest.mark.parametrize("source", CASES, ids=range(len(CASES)))
def test_main_text(source):
    assert sitetree.main_text(source) == CASES[source]


def test_broken_pages_do_not_crash():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<a href=\"", "'", "\"", ">", "<", "&amp", "text ", "<!--", "-->", "<script>", "</script>", "<li>", "<td>", "<b>", "</b>", "<br/>"]
    for _ in range(3000):
        sitetree.main_text("".join(rng.choices(bits, k=rng.randint(1, 25))))


def test_site_tree_removes_what_a_host_repeats(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    boiler = [words(4) for _ in range(3)]
    rows, want = [], {}
    for i in range(60):
        body = words(20)
        rows.append((i, f"http://h.org/{i}", f"<body><div class=u{i % 2}><div class=top>{rng.choice(boiler)}</div><div class=text><p>{body}</p></div></div>", "a", "b"))
        want[i] = body
    rows += [(100, None, "<p>lone</p>", "a", "b"), (101, "no host", None, "a", "b"), (102, "http://one.org", "<div class=top>kept</div>", "a", "b")]
    want |= {100: "lone", 101: "", 102: "kept"}
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, _host string, text string")
    got = sitetree.extract_main_text(df)
    assert got.columns == ["page_id", "url", "_host", "text"]
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    assert sitetree.extract_main_text(df.limit(0)).count() == 0


def test_same_article_on_all_pages_is_kept(spark):
    rows = [(i, "http://h.org/", "<article><p>the same words</p></article>") for i in range(30)]
    got = sitetree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(got) == 30 and {r["text"] for r in got} == {"the same words"}


def test_copies_of_a_page_do_not_make_its_text_a_template(spark):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    page = lambda head, body: f"<body><h1>{head}</h1><div class=content><p>{body}</p></div><div class=end>same end</div></body>"
    hot, rows, want = (words(2), words(20)), [], {}
    for i in range(200):  # half of one host's pages are copies; another host has the same template
        head, body = hot if i % 2 else (words(2), words(20))
        rows.append((i, f"http://h.org/{i}", page(head, body)))
        want[i] = f"{head} {body}"
    for i in range(200, 220):
        head, body = words(2), words(20)
        rows.append((i, f"http://other.org/{i}", page(head, body)))
        want[i] = f"{head} {body}"
    got = sitetree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_words_in_classes_only_lower_importance(spark):
    for page in (
        "<body class='single has-sidebar'><p>kept</p></body>",
        "<div id=page-nav-open><div class=x><article><p>kept</p></article></div></div>",
        "<article class='post comments-open'><p>kept</p></article>",
        "<div id=page-nav-open><p>kept</p></div>",
        "<body class=has-sidebar><main><p>kept</p><div class=sidebar>no</div></main></body>",
    ):
        assert sitetree.main_text(page) == "kept"
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        want[i] = words(20)
        rows.append((i, "http://h.org", f"<h1>{i} {words(1)}</h1><div class=has-sidebar><p>{want[i]}</p><p class=share>send it</p></div>"))
    got = sitetree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    for r in got.collect():
        assert r["text"].endswith(want[r["page_id"]])


def test_repeated_text_in_main_goes(spark):
    rows = [(i, "http://h.org", f"<main><div class=x>the same notice</div><p>text of {i}</p></main><nav>{i}</nav>") for i in range(40)]
    got = sitetree.extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert all(r["text"] == f"text of {r['page_id']}" for r in got.collect())


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
