"""Landed files: search hits, fetched pages, local HTML files, CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS_SCHEMA = (
    "subject_id bigint, query_ord int, search_query string, "
    "hits array<struct<href string, title string, body string>>"
)
FETCH_SCHEMA = "search_result_id bigint, final_url string, http_status int, content_type string, html string"
REPORT_SCHEMA = (
    "label string, precision double, recall double, f1_score double, support double, timestamp string"
)
MISTAKE_SCHEMA = "email_id bigint, actual string, predicted string, sender_email_domain string"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one query with its hit list each; one row per hit out, ranks start at 1."""
    feed = spark.read.schema(HITS_SCHEMA).json(path)
    exploded = feed.select("subject_id", "query_ord", "search_query", F.posexplode("hits").alias("pos", "hit"))
    return exploded.select(
        "subject_id",
        "query_ord",
        "search_query",
        (F.col("pos") + 1).alias("result_rank"),
        *[F.coalesce(f"hit.{c}", F.lit("")).alias(c) for c in ("href", "title", "body")],
    )


def read_fetches(spark: SparkSession, path: str, source: str = "parquet") -> DataFrame:
    return normalise_fetches(spark.read.schema(FETCH_SCHEMA).format(source).load(path))


def normalise_fetches(fetches: DataFrame) -> DataFrame:
    return fetches.withColumn("content_type", F.lower(F.coalesce("content_type", F.lit(""))))


def read_html_files(spark: SparkSession, path: str, candidates: DataFrame | None = None) -> DataFrame:
    """Local HTML files as fetched pages: status 200, ``text/html``.

    With ``candidates`` (``id, url``, ``file://`` urls) every candidate gives a
    row; one without a file has no html and status null, which counts as failed.
    """
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        .select(
            F.concat(F.lit("file://"), F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")).alias("final_url"),
            F.lit(200).alias("http_status"),
            F.lit("text/html").alias("content_type"),
            F.col("value").alias("html"),
        )
    )
    if candidates is None:
        return files
    wanted = candidates.select(F.col("id").alias("search_result_id"), F.col("url").alias("final_url"))
    # Paths in file urls are percent-encoded, on either side or on one only.
    plain = F.try_url_decode(F.replace("final_url", F.lit("+"), F.lit("%2B")))
    keyed = wanted.withColumn("_path", F.coalesce(plain, "final_url"))
    found = files.withColumn("_path", F.coalesce(plain, "final_url")).drop("final_url")
    return keyed.join(found, "_path", "left").drop("_path")


def read_report_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).option("header", "true").option("escape", '"').csv(path)


def read_mistakes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MISTAKE_SCHEMA).option("header", "true").option("escape", '"').csv(path)
