"""Literal input to literal output."""

import math

import pytest
from patronvoice import functions as fn
from patronvoice.sources.fixed import TAXONOMY, taxonomy_for
from pyspark.sql import functions as F

def check(spark, func, cases, dtype="string"):
    rows = [(i, c) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, c {dtype}")
    got = [r["x"] for r in df.select("i", func(F.col("c")).alias("x")).orderBy("i").collect()]
    want = [w for _, w in cases]
    assert got == want


def test_parse_rating(spark):
    check(
        spark,
        fn.parse_rating,
        [("4.1/5", 4.1), ("3.8 /5", 3.8), ("NEW", None), ("-", None), ("", None), ("6.0", None), ("0.9", None), ("5", 5.0), (None, None), ("1.0/5", 1.0)],
    )


def test_parse_count(spark):
    check(spark, fn.parse_count, [("1,234", 1234), ("-3", None), ("1.5", None), (" 7 ", 7), ("abc", None), ("1e3", 1000), ("0", 0), (None, None), ("1e30", None)])


def test_parse_money(spark):
    check(spark, fn.parse_money, [("₹1,200", 1200.0), ("0", None), ("-5", None), ("₹ 2 500", 2500.0), ("99.5", 99.5), ("free", None), (None, None)])


def test_coerce_numeric_rejects_lookalikes(spark):
    check(spark, fn.coerce_numeric, [("NaN", None), ("inf", None), ("12d", None), ("1e999", None), ("+.5", 0.5), ("7.", 7.0), ("\t8\n", 8.0), ("", None)])


def test_encode_yes_no(spark):
    check(spark, fn.encode_yes_no, [("Yes", 1), (" yes ", 1), ("no", 0), ("maybe", 0), (None, 0)])


def test_title_case(spark):
    samples = ["mcdonald's bbq-nation 3rd", "  cafe   COFFEE\tday ", "a1b2 c_d", "", "ünder über-all", "x"]
    check(spark, fn.title_case_clean, [(s, " ".join(s.split()).title()) for s in samples] + [(None, None)])


def test_strip_knows_every_space(spark):
    spaces = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    check(spark, fn.strip_text, [(spaces + "a b" + spaces, "a b"), ("  ", ""), (None, None)])


def test_list_spacing_and_primary_value(spark):
    check(spark, fn.normalize_list_spacing, [(" North Indian ,Chinese,  Thai ", "North Indian, Chinese, Thai")])
    check(spark, fn.primary_value, [("North Indian, Chinese", "North Indian"), ("Unknown", None), ("", ""), (None, None)])


def test_clean_review_text(spark):
    check(
        spark,
        fn.clean_review_text,
        [
            ("café ₹450 <b>", "café 450 b"),
            ("see http://x.y/z?a=1 now", "see now"),
            ("www.site.com good...... really...", "good. really."),
            ("a  b\tc\n\nd\u00a0\u3000e", "a b c d e"),
            ("tick's - dash, ok! no? yes.", "tick's - dash, ok! no? yes."),
            ("@@@#$%", ""),
            ("", ""),
            ("\u2003lead and trail\x1f", "lead and trail"),
            ("x@ y @z @ w", "x y z w"),
            ("日本語 テスト 12٣ ½ a_b", "日本語 テスト 12٣ ½ a_b"),
            ("a. . b.. .c", "a. . b. .c"),
            (None, None),
        ],
    )


def test_tokens(spark):
    samples = ["", " ", "a", "a b c d e", "  a\tb\n c ", "one two three four"]
    check(spark, fn.token_count, [(s, len(s.split())) for s in samples])
    check(spark, lambda c: fn.has_min_tokens(c, 4), [(s, len(s.split()) >= 4) for s in samples])


def test_unescape_and_truncate(spark):
    check(spark, fn.unescape_newline, [("RATED\\n  Great", "RATED   Great"), (" a\nb ", "a\nb")])
    check(spark, lambda c: fn.truncate_for_model(c, 5), [(" ab\ncdefg", "ab cd")])
    check(spark, lambda c: fn.truncate_for_model(c, None), [("a" * 2000, "a" * 2000)])


@pytest.mark.parametrize(
    "func, cases",
    [
        (fn.bin_cost_tier, [(300.0, "budget"), (300.5, "low-mid"), (600.0, "low-mid"), (1000.0, "mid"), (2000.0, "premium"), (2001.0, "luxury"), (0.0, None), (None, None)]),
        (fn.bin_rating_tier, [(0.0, None), (3.0, "low"), (3.1, "average"), (4.0, "good"), (5.0, "excellent"), (5.1, None), (None, None)]),
        (fn.bin_rating_star, [(1.0, None), (1.1, "1-2 stars"), (2.0, "1-2 stars"), (3.5, "3-3.5 stars"), (5.0, "4-5 stars"), (None, None)]),
    ],
)
def test_bins(spark, func, cases):
    check(spark, func, cases, "double")


def test_equal_width_bin_matches_edges(spark):
    import numpy as np

    values = sorted({*np.linspace(-1, 1, 40).tolist(), *np.linspace(-1, 1, 401).tolist(), -0.999999999, 0.1, 0.3})
    counts, _ = np.histogram(values, bins=39, range=(-1, 1))
    df = spark.createDataFrame([(float(v),) for v in values], "c double")
    got = {r["b"]: r["count"] for r in df.groupBy(fn.equal_width_bin(F.col("c"), -1, 1, 39).alias("b")).count().collect()}
    assert got == {i: int(n) for i, n in enumerate(counts) if n}
    check(spark, lambda c: fn.equal_width_bin(c, -1, 1, 39), [(1.0, 38), (-1.0, 0), (1.01, None), (None, None)], "double")


def test_half_even(spark):
    check(spark, lambda c: fn.round_half_even(c, 1), [(0.25, 0.2), (0.35, 0.4), (-0.25, -0.2), (None, None)], "double")
    check(spark, fn.round_half_even, [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0)], "double")


def test_scores(one):
    low = fn.neutral_threshold(F.col("l"), F.col("s"))
    assert one(low, l="POSITIVE", s=0.7499) == "neutral"
    assert one(low, l="POSITIVE", s=0.75) == "positive"
    assert one(low, l="NEGATIVE", s=0.9) == "negative"
    signed = fn.signed_score(F.col("t"), F.col("s"))
    assert [one(signed, t=t, s=0.8) for t in ("positive", "negative", "neutral")] == [0.8, -0.8, 0.0]
    assert one(fn.popularity_score(F.col("v")), v=100) == round(math.log1p(100), 3)
    assert one(fn.complement_pct(F.col("a"), F.col("b")), a=80.0, b=30.0) == 0.0
    assert one(fn.complement_pct(F.col("a"), F.col("b")), a=50.1, b=20.2) == 29.7
    assert one(fn.rice_score(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=1, b=1.0, c=1, d=0.0) is None


def test_parse_reviews(spark):
    cases = [
        ("[('Rated 5.0', 'RATED\\n Great'), ('Rated 3.0', 'Average')]", [("Rated 5.0", "RATED\n Great"), ("Rated 3.0", "Average")]),
        ("[]", []),
        ("[broken", []),
        ("{'a': 1}", []),
        ("[('only one',), 'text', ('a', 'b', 'c')]", [("a", "b")]),
        ("__import__('os')", []),
        ("", []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = [[tuple(r) for r in row["x"]] for row in df.select("i", fn.parse_reviews(F.col("c")).alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


def test_parse_reviews_json(spark):
    check(spark, lambda c: F.size(fn.parse_reviews(c, "json")), [('[{"rating":"5","text":"ok"}]', 1), ("[oops", 0), (None, 0)])


def test_review_texts(one):
    texts = fn.review_texts(fn.parse_reviews(F.col("c")))
    literal = "[('1', ' a\\\\nb '), ('2', 'nan'), ('3', '  '), ('4', None)]"
    assert one(texts, c=literal) == ["a b", "None"]
    assert one(fn.review_count(texts), c=literal) == 2


def test_keyword_helpers(one):
    weights = fn.keyword_weight_map(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.123456), F.lit(0.5)), 1)
    assert one(weights, c=1) == {"a": 0.1235}
    assert one(fn.split_keywords(F.col("c"), 2), c="a , b,c") == ["a", "b"]
    assert one(fn.join_keywords(F.split(F.col("c"), ",")), c="a,b") == "a, b"
    assert one(fn.topic_short_name(F.col("c")), c="3_late_food") == "late"
    assert one(fn.topic_short_name(F.col("c"), 4), c="abcdef") == "abcd"


def test_derive_label(spark):
    df = spark.createDataFrame(
        [(0, ["dirty"]), (1, ["foo", "bar", "baz", "qux"]), (2, []), (3, ["Late", "ITEM"]), (4, ["cold food"]), (5, ["refund", "late", "slow"])],
        "i int, c array<string>",
    )
    got = [r["x"] for r in df.select("i", fn.derive_label(F.col("c"), TAXONOMY).alias("x")).orderBy("i").collect()]
    assert got == ["Hygiene & cleanliness", "Foo / Bar / Baz", "Other complaints", "Delivery & wait time", "Cold Food", "Delivery & wait time"]
    phrases = df.where("i = 4").select(fn.derive_label(F.col("c"), TAXONOMY, split_phrases=True).alias("x")).first()["x"]
    assert phrases == "Food quality"
    assert dict(taxonomy_for("Acme"))["App & online ordering"][-1] == "acme"


def test_search_and_highlight(spark):
    check(spark, lambda c: fn.search_predicate(c, "cold.food"), [("Cold-food", True), ("warm", False), (None, False)])
    check(spark, lambda c: fn.search_predicate(c, "a.b", "literal"), [("xA.Bx", True), ("aXb", False)])
    check(spark, lambda c: fn.highlight_matches(c, "a.b"), [("xA.Bx aXb", "x<mark>A.B</mark>x aXb")])
    check(spark, lambda c: fn.highlight_matches(c, ""), [("same", "same")])
    with pytest.raises(ValueError):
        fn.search_predicate(F.col("c"), "a", "fuzzy")
