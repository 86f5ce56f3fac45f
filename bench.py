"""Times the headline queries; prints one JSON line.

Each query is written to Spark's no-op sink, so every row and column is computed
and nothing is collected. One untimed query warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

from patronvoice.session import local_session
from registry import QUERIES

HEADLINE = (
    "top_negative_entities",
    "keep_most_complete",
    "clean_listings",
    "quartiles_iqr",
    "group_median",
    "winsorize_iqr",
    "impute_group_median",
    "explode_reviews",
    "fill_defaults_after_join",
    "sentiment_by_type",
    "sentiment_vs_rating",
    "score_histogram",
    "kpi_overview",
    "complaints_by_city",
    "topics_over_rating",
    "map_topics_to_entities",
    "clean_review_text",
    "negative_reviews",
    "term_counts",
    "class_tfidf",
    "top_keywords",
    "search_reviews",
    "rice_summary",
    "column_profile",
    "score_sentiment",
    "embed_texts",
    "cluster_density",
    "fit_topics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, **{"spark.ui.showConsoleProgress": "false"})
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cores)}))


if __name__ == "__main__":
    main()
