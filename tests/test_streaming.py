"""Streams give what the batch jobs give, and a re-run adds nothing."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from exposight.functions import urls
from exposight.operators import matching
from exposight.plans import crawl
from exposight.sources import landed
from exposight.streaming import pages as streams
from exposight.verification import registry


def test_analyse_stream_equals_batch_and_is_idempotent(spark, tmp_path):
    rows = [
        (i, f"https://h.example.com/{i}", 404 if i == 5 else 200, "text/html",
         f"<title>T{i}</title><p>Ana Testwell{i % 3} 01632 96000{i % 4}</p><a href='/contact'>contact</a>") for i in range(12)
    ]
    fetches = spark.createDataFrame(rows, landed.FETCH_SCHEMA)
    terms = spark.createDataFrame(
        [(1, "name", "Ana Testwell1", 1.0), (1, "phone", "01632 960002", 1.0)], "subject_id bigint, entity_type string, entity_value string, confidence double"
    )
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    keys = ["subject_id", "page_id", "entity_type", "entity_value"]
    tables = {
        "findings": keys, "crawl_events": ["search_result_id", "crawl_status"], "crawled_pages": ["page_id", "page_title"],
        "page_links": ["page_id", "url", "link_type"], "page_phones": ["page_id", "phone_number"], "page_risk": ["page_id", "risk_score"],
    }

    def run():
        stream = streams.landed_pages(spark, landing, landed.FETCH_SCHEMA, files_per_batch=2)
        streams.analyse_stream(stream, terms, out, str(tmp_path / "checkpoint")).awaitTermination()
        return {t: sorted(tuple(r) for r in spark.read.parquet(f"{out}/{t}").select(*c).collect()) for t, c in tables.items()}

    fetches.repartition(3).write.parquet(landing)
    first = run()
    parsed = crawl.parse_pages(fetches.where("http_status < 400").withColumn("page_id", F.col("search_result_id")), base_url="final_url")
    found = matching.findings(parsed, terms)
    assert first["findings"] == sorted(tuple(r) for r in found.select(keys).collect())
    assert first["page_risk"] == sorted(
        tuple(r) for r in matching.page_risk(parsed, matching.risk_scores(found)).select("page_id", "risk_score").collect()
    )
    assert len(first["crawl_events"]) == 12 and (5, "failed") in first["crawl_events"]
    assert [len(first[t]) for t in ("crawled_pages", "page_links", "page_phones")] == [11, 11, 11]
    assert run() == first
    fetches.limit(4).write.mode("append").parquet(landing)
    assert run() == first


def test_new_urls_once_over_runs(spark, tmp_path):
    rows = [(1, "http://h.example.com/a?x"), (1, "http://h.example.com/a#y"), (2, "http://h.example.com/a"), (1, ""), (1, None), (1, "http://h.example.com/b")]
    schema = "subject_id bigint, href string, seen timestamp"
    hits = spark.createDataFrame(rows, "subject_id bigint, href string").withColumn("seen", F.lit("2024-01-01").cast("timestamp"))
    batch = hits.where("coalesce(href, '') <> ''").select("subject_id", urls.canonical(F.col("href")).alias("url")).distinct()
    want = sorted(map(tuple, batch.collect()))
    for name, options in (("plain", {}), ("watermark", {"event_time": "seen", "keep_for": "1 hour"})):
        landing, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")

        def run():
            stream = streams.landed_pages(spark, landing, schema, files_per_batch=1)
            streams.write_new_urls(stream, out, str(tmp_path / name / "checkpoint"), **options).awaitTermination()
            found = spark.read.parquet(out)
            assert set(found.columns) == {"subject_id", "href", "seen", "url"}
            return sorted((r["subject_id"], r["url"]) for r in found.collect())

        hits.coalesce(1).write.parquet(landing)
        assert run() == want
        hits.coalesce(1).write.mode("append").parquet(landing)
        assert run() == want


def test_fetches_land_by_as_many_tasks_as_a_shuffle_has(spark, monkeypatch):
    """No task writes all rows; there are three batches at any number of files."""

    class Landed(Exception):
        pass

    def landed_pages(spark, folder, schema, files_per_batch):
        raise Landed(folder, files_per_batch)

    monkeypatch.setattr(registry.streams, "landed_pages", landed_pages)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        with pytest.raises(Landed) as landed:
            registry.QUERIES["stream_analyse"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    folder, files_per_batch = landed.value.args
    assert (len(list(Path(folder).glob("*.parquet"))), files_per_batch) == (12, 4)
