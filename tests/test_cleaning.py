import json

import pytest
from patronvoice.operators import cleaning as ops
from patronvoice.operators import quality
from patronvoice.plans.clean import CleanParams, clean_listings, clean_rows, cleaning_audit, run_cleaning
from patronvoice.sources.readers import RAW_COLUMNS, read_cleaned, read_raw_listings
from patronvoice.sources.writers import write_table
from patronvoice.streaming import clean_stream
from pyspark.sql import functions as F

ROWS = [
    # the same url three times, the second row is the most complete
    ("u1", " 1st road ", "cafe coffee day", "Yes", None, "4.1/5", "1,234", None, "btm", "quick bites", None, "North Indian ,Chinese", "800", "[('Rated 5.0', 'Great food')]", None, "buffet", "  btm   layout "),
    ("u1", " 1st road ", "cafe coffee day", "Yes", "no ", "4.1/5", "1,234", "080", "btm", "quick bites", "tea", "North Indian ,Chinese", "800", "[('Rated 5.0', 'Great food')]", None, "buffet", "  btm   layout "),
    ("u1", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("u2", None, "bbq-nation", "maybe", "Yes", "NEW", "abc", None, "hsr", "quick bites", None, None, "₹1,200", "[broken", None, "delivery", "hsr"),
    ("u3", None, "mcdonald's", None, None, None, "-3", None, None, "cafe", None, None, None, "[]", None, None, None),
    ("u4", None, "x", "No", "No", "3.8 /5", "10", None, "btm", "quick bites", None, "Thai", None, None, None, "buffet", "btm"),
    (None, None, None, None, None, "5/5", None, None, None, None, None, None, None, None, None, None, None),
    (None, None, "no url", None, None, "6.0/5", None, None, None, None, None, None, "300", None, None, None, None),
]


@pytest.fixture(scope="module")
def raw(spark):
    schema = ", ".join(f"`{c}` string" for c in RAW_COLUMNS)
    return spark.createDataFrame(ROWS, schema)


@pytest.fixture(scope="module")
def cleaned(raw):
    return {r["url"]: r for r in clean_listings(raw).collect()}


def test_names(raw):
    names = ops.normalize_column_names(raw.withColumn(" Odd (Name)__x ", F.lit(1))).columns
    assert names[-1] == "odd_name_x" and {"approx_cost", "listed_type", "listed_city"} <= set(names)


def test_whole_job(cleaned):
    assert set(cleaned) == {"u1", "u2", "u3", "u4", None}
    u1, u2, u3, u4, none = (cleaned[k] for k in ("u1", "u2", "u3", "u4", None))
    assert (u1["phone"], u1["dish_liked"], u1["name"], u1["address"]) == ("080", "tea", "Cafe Coffee Day", "1st road")
    assert (u1["cuisines"], u1["primary_cuisine"], u1["listed_city"]) == ("North Indian, Chinese", "North Indian", "Btm Layout")
    assert (u1["votes"], u1["rate"], u1["rating_tier"], u1["cost_tier"]) == (1234, 4.1, "excellent", "mid")
    assert (u1["online_order_enc"], u1["book_table_enc"], u1["book_table"]) == (1, 0, "no ")
    assert (u1["review_texts"], u1["review_count"], u1["has_reviews"]) == (["Great food"], 1, 1)
    assert (u2["rate"], u2["rate_missing"], u2["votes"], u2["votes_outlier"]) == (None, 0, None, 0)
    assert (u2["review_texts"], u2["reviews_list"], u2["name"]) == ([], [], "Bbq-Nation")
    assert (u3["rate_missing"], u3["votes"], u3["rating_tier"], u3["primary_cuisine"]) == (1, None, None, None)
    # quick bites cost 800 and 1200; cafe has none, so the median of 800 1200 1000 300 serves
    assert (u4["approx_cost"], u3["approx_cost"]) == (1000, 900)
    # 300 lies under the bound 800 - 1.5 x 200; its tier is of the cost before capping
    assert (none["approx_cost"], none["approx_cost_outlier"], none["cost_tier"]) == (500, 1, "budget")
    assert (none["name"], none["rate"]) == ("No Url", None)


def test_schema_tolerance(spark):
    df = spark.createDataFrame([("u", "n", "4.0/5"), ("u", "n", None)], "url string, name string, rate string")
    got = clean_listings(df).collect()
    assert [(r["rate"], r["rate_missing"]) for r in got] == [(4.0, 0)]
    costs = spark.createDataFrame([("a", "10"), ("b", None), ("c", "30")], "name string, approx_cost string")
    assert sorted(r["approx_cost"] for r in clean_listings(costs, CleanParams(caps={})).collect()) == [10, 20, 30]


def test_approximate_job_has_the_same_shape(raw, cleaned):
    got = clean_listings(raw, CleanParams(approx=True))
    assert got.columns and got.count() == len(cleaned)


def test_dedup_ties_and_hot_null_key(spark):
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).cast("string").alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit("x")).alias("a"),
        (F.col("id") % 50).cast("string").alias("b"),
    )
    runs = [sorted(map(tuple, ops.keep_most_complete(df.repartition(n), "k").collect()), key=str) for n in (1, 8)]
    assert runs[0] == runs[1] and len(runs[0]) == 8
    assert all(r[1] == "x" for r in runs[0])
    maps = spark.sql("SELECT 1 k, map('a', 1) m, CAST(NULL AS int) x UNION ALL SELECT 1, map('b', 2), 3")
    assert ops.keep_most_complete(maps, "k").first()["m"] == {"b": 2}


def test_duplicates(spark, raw):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("b", None), ("a", 2)], "x string, y int")
    assert ops.distinct_dup_count(df).first()[0] == 2
    assert ops.distinct_dup_count(df, ["x"]).first()[0] == 3
    assert ops.drop_exact_duplicates(df).count() == 3


def test_audit(raw):
    audit = {(r["step"], r["column"], r["action"]): r["rows_affected"] for r in cleaning_audit(raw, clean_listings(raw)).collect()}
    assert audit["load", "all", "raw load"] == 8
    assert audit["duplicates", "all", "total rows removed"] == 3
    assert audit["missing", "name", "dropped rows with null identity column"] == 0
    assert audit["missing", "phone", "filled with ''"] == 4
    assert audit["parse", "votes", "parsed to number"] == 2
    assert audit["encode", "online_order", "Yes/No to 1/0"] == 1
    assert audit["impute", "approx_cost", "filled with group median"] == 2


def test_validate(spark):
    df = spark.createDataFrame([("a", 6.0, -1), ("a", 3.0, 2), ("b", None, None)], "url string, rate double, votes long")
    got = {(r["check"], r["column"]): (r["violations"], r["status"]) for r in quality.validate(df, min_rows=3).collect()}
    assert got == {
        ("unique", "url"): (1, "FAIL"),
        ("in_range", "rate"): (1, "FAIL"),
        ("non_negative", "votes"): (1, "FAIL"),
        ("min_rows", "all"): (0, "PASS"),
    }
    with pytest.raises(ValueError, match="url: 1 violations of unique"):
        quality.validate(df, raise_=True)


def test_profile(spark):
    df = spark.createDataFrame([(1, ["a"], "x"), (1, ["a"], None), (2, ["b"], "x"), (None, None, "y")], "n int, l array<string>, s string")
    for approx in (False, True):
        got = {r["column"]: (r["dtype"], r["null_pct"], r["distinct_values"]) for r in quality.column_profile(df, approx).collect()}
        assert got == {"n": ("int", 25.0, 2), "l": ("array<string>", 25.0, 2), "s": ("string", 25.0, 2)}
    assert {r["column"]: r["nulls"] for r in quality.null_summary(df).collect()} == {"n": 1, "l": 1, "s": 1}


def test_files_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "raw.csv")
    quoted = '"Rated ""x""\nsecond line"'
    lines = [",".join(RAW_COLUMNS)] + [f'u{i},a,n{i},Yes,N/A,4.0/5,"1,00{i}",null,nan,t,d,c,100,{quoted},NA,ty,ci' for i in range(5)]
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    df = read_raw_listings(spark, path)
    row = df.orderBy("url").first()
    assert row["book_table"] is None and row["location"] is None and row["menu_item"] is None
    assert row["reviews_list"] == 'Rated "x"\nsecond line' and row["votes"] == "1,000"
    out = run_cleaning(spark, path, str(tmp_path / "out"), min_rows=5)
    assert out.count() == 5
    report = json.loads((next((tmp_path / "out/cleaning_report").glob("*.json"))).read_text())
    assert report["final_shape"]["rows"] == 5 and any(s["step"] == "duplicates" for s in report["cleaning_steps"])
    with pytest.raises(ValueError, match="min_rows"):
        run_cleaning(spark, path, str(tmp_path / "out2"))
    flat = str(tmp_path / "flat")
    write_table(out.withColumn("review_texts", F.array(F.lit('a "b"'), F.lit("c,d"))), flat, "csv")
    back = read_cleaned(spark, flat, fmt="csv").first()
    assert back["review_texts"] == ['a "b"', "c,d"] and back["rate"] == 4.0


def test_row_steps_run_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "4.1/5", "1,000", None), ("b", None, "x", "₹90")], "name string, rate string, votes string, approx_cost string").write.parquet(src)
    batch = spark.read.parquet(src)
    out, noted = str(tmp_path / "out"), str(tmp_path / "noted")
    for times in (1, 2):  # what has been written is not written again
        if times == 2:
            batch.write.mode("append").parquet(src)
        clean_stream(spark.readStream.schema(batch.schema).parquet(src), out, noted).awaitTermination(120)
        assert sorted(spark.read.parquet(out).collect()) == sorted(clean_rows(batch).collect() * times)
