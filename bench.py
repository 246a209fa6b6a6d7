"""Headline queries, timed. Prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (warm runs, default 3).
Each query runs once cold, then the median of the warm runs counts; results go to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from exposight.session import local_session
from exposight.verification.registry import QUERIES

HEADLINE = [
    "analyse_pages",
    "page_text",
    "parse_pages",
    "mail_training_rows",
    "label_counts",
    "discovery_ingest",
    "tfidf",
    "classification_report",
    "stratified_split",
    "search_queries",
    "stream_analyse",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in names:
        cold[name] = round(timed(spark, name, sf_dir), 3)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "sum of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "cold": cold, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
