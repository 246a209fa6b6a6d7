"""Incremental forms: only what has not been handled yet, each input once.

The checkpoint of a stream takes the place of the status flag of a polled
queue. All streams run with ``availableNow``: they take what has landed and stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from exposight.functions import urls
from exposight.operators import matching
from exposight.plans import crawl
from exposight.sources.sinks import write_batch


def landed_pages(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def first_fetches(fetches: DataFrame, event_time: str | None = None, keep_for: str | None = None) -> DataFrame:
    """The first fetched row of every candidate over all batches and runs.

    The stream's own state remembers the candidates: all of them, or with ``event_time`` and ``keep_for`` those of
    that time.
    """
    key = ["search_result_id"]
    if event_time and keep_for:
        return fetches.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(key)
    return fetches.dropDuplicates(key)


def analyse_stream(
    fetches: DataFrame, terms: DataFrame, out_folder: str, checkpoint: str,
    event_time: str | None = None, keep_for: str | None = None,
) -> StreamingQuery:
    """Take in landed fetches and match their pages: the tables of ``crawl.ingest``, ``findings`` and ``page_risk``.

    Every batch writes folders of its own, so its cost does not grow with what is stored, and a replayed batch
    replaces its rows.
    """

    prepared = matching.prepare(terms)  # once, not per batch

    def handle(batch: DataFrame, number: int) -> None:
        stored = crawl.ingest(batch, out_folder, number)
        found = matching.findings(stored, prepared)
        write_batch(found, f"{out_folder}/findings", number)
        again = stored.sparkSession.read.schema(found.schema).parquet(f"{out_folder}/findings/batch={number}")
        write_batch(matching.page_risk(stored, matching.risk_scores(again)), f"{out_folder}/page_risk", number)

    return (
        first_fetches(fetches, event_time, keep_for)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def new_urls(hits: DataFrame, event_time: str | None = None, keep_for: str | None = None) -> DataFrame:
    """The first hit of each canonical address of a subject over all runs, with all its columns.

    Without a watermark every address is remembered for good. With ``event_time``
    and ``keep_for`` addresses are forgotten after that time and state stays bounded.
    """
    named = hits.where(F.coalesce("href", F.lit("")) != "").withColumn("url", urls.canonical(F.col("href")))
    key = ["subject_id", "url"]
    if event_time and keep_for:
        return named.withWatermark(event_time, keep_for).dropDuplicatesWithinWatermark(key)
    return named.dropDuplicates(key)


def write_new_urls(
    hits: DataFrame, out_folder: str, checkpoint: str, event_time: str | None = None, keep_for: str | None = None
) -> StreamingQuery:
    return (
        new_urls(hits, event_time, keep_for)
        .writeStream.format("parquet")
        .option("path", out_folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
