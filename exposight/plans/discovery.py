"""Discovery: subjects to search queries, search hits to stored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import people, urls
from exposight.operators.rows import first_per_key, insert_or_ignore


def subjects_from(raw: DataFrame) -> DataFrame:
    """Identity rows with JSON text lists to rows with string arrays."""
    lists = ["middle_names", "usernames", "locations", "numbers"]
    return raw.withColumns({c: people.string_list(F.col(c)) for c in lists})


def search_queries(subjects: DataFrame) -> DataFrame:
    """``subject_id, query_ord, search_query, query_confidence``: every query once, in search order."""
    exploded = subjects.select("*", F.posexplode(people.queries_of()).alias("query_ord", "search_query"))
    return exploded.select(
        "subject_id", "query_ord", "search_query", people.query_confidence(F.col("search_query")).alias("query_confidence")
    )


def top_hits(hits: DataFrame, k: int = fv.HITS_PER_QUERY) -> DataFrame:
    return first_per_key(hits, ["subject_id", "query_ord"], ["result_rank"], k)


def first_seen(hits: DataFrame) -> DataFrame:
    """Hits with an address, canonical, each address once per subject: earliest query, then best rank."""
    named = hits.where(F.coalesce("href", F.lit("")) != "").withColumn("url", urls.canonical(F.col("href")))
    return first_per_key(named, ["subject_id", "url"], ["query_ord", "result_rank"])


def with_query_confidence(hits: DataFrame, subjects: DataFrame) -> DataFrame:
    """Confidence is worked out once per distinct query, then joined to its hits."""
    queries = hits.select("subject_id", "search_query").distinct()
    rated = queries.join(subjects, "subject_id").select(
        "subject_id", "search_query", people.query_confidence(F.col("search_query")).alias("query_confidence")
    )
    return hits.join(rated, ["subject_id", "search_query"])


def ingest(hits: DataFrame, subjects: DataFrame, stored: DataFrame, k: int = fv.HITS_PER_QUERY) -> DataFrame:
    """New candidate rows: top hits, first seen, not stored yet; ready to append."""
    fresh = insert_or_ignore(first_seen(top_hits(hits, k)), stored, ["subject_id", "url"])
    rated = with_query_confidence(fresh, subjects)
    return rated.select(
        candidate_id(F.col("subject_id"), F.col("url")).alias("id"),
        "subject_id",
        F.lit(fv.SEARCH_ENGINE).alias("search_engine"),
        "search_query",
        "query_confidence",
        "url",
        urls.domain(F.col("url")).alias("domain"),
        F.coalesce("title", F.lit("")).alias("page_title"),
        F.coalesce("body", F.lit("")).alias("snippet"),
        "result_rank",
        F.lit("pending").alias("crawl_status"),
        F.lit(0).alias("crawl_attempts"),
    )


def candidate_id(subject_id: Column, url: Column) -> Column:
    """Stable key of a candidate: the same row gets the same id on every run."""
    return F.xxhash64(subject_id, url)
