"""Review queues, page details and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import text as tx
from exposight.operators.rows import latest_per_key


def _mode(mode: str) -> Column:
    pending = F.col("verification_status") == "pending"
    risk, match = F.col("risk_score"), F.col("match_score")
    modes = {
        "candidates": pending & ((risk > 0) | (match > 0)),
        # A null score is not 0, so such a page is in neither of the two.
        "false_negatives": pending & (risk == 0) & (match == 0),
        "all_pending": pending,
        "previous": F.col("verification_status").isin(fv.DECIDED_STATUSES),
    }
    if mode not in modes:
        raise ValueError(f"unknown review mode: {mode}")
    return modes[mode]


def with_risk(pages: DataFrame, risks: DataFrame) -> DataFrame:
    """Pages with the score of their analysis (``page_id, risk_score`` per page and subject): the highest of any
    subject. A page that was not analysed keeps its score."""
    highest = risks.groupBy(F.col("page_id").alias("id")).agg(F.max("risk_score").cast("double").alias("_risk"))
    scored = pages.join(highest, "id", "left")
    return scored.withColumn("risk_score", F.coalesce("_risk", "risk_score")).drop("_risk")


def review_queue(pages: DataFrame, candidates: DataFrame, mode: str) -> DataFrame:
    """Pages of one queue with their address, most exposed first."""
    urls = candidates.select(F.col("id").alias("search_result_id"), "url")
    queue = pages.where(_mode(mode)).join(urls, "search_result_id")
    return queue.orderBy(F.desc_nulls_last("risk_score"), F.desc_nulls_last("match_score"), F.asc("id"))


def review_detail(pages: DataFrame, findings: DataFrame) -> DataFrame:
    """Per page and subject: title, preview and the findings as display lines, surest first.

    A list holds one subject's findings on one page, so it is no longer than the
    subject's own terms.
    """
    line = tx.finding_line(F.col("entity_type"), F.col("entity_value"), F.col("confidence"))
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("confidence")).alias("o"), F.col("entity_type"), F.col("entity_value"), line.alias("line")))
    )
    lists = findings.groupBy("page_id", "subject_id").agg(ordered.alias("found"))
    lines = lists.select("page_id", "subject_id", F.transform("found", lambda f: f["line"]).alias("finding_lines"))
    shown = pages.select(
        F.col("id").alias("page_id"),
        tx.or_unknown(F.col("page_title")).alias("page_title"),
        tx.preview(F.col("extracted_text")).alias("preview"),
    )
    none = F.array().cast("array<string>")
    return shown.join(lines, "page_id", "left").withColumn("finding_lines", F.coalesce("finding_lines", none))


def decided_status(choice: Column) -> Column:
    """Status a choice stands for; null for a choice that decides nothing (skip, quit)."""
    status = F.lit(None).cast("string")
    for key, value in fv.REVIEW_CHOICES.items():
        status = F.when(choice == key, value).otherwise(status)
    return status


def apply_decisions(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """Current status of every page: its latest decision, else what is stored."""
    made = decisions.select("page_id", "ts", "event_id", decided_status(F.lower("choice")).alias("decided"))
    latest = latest_per_key(made.where(F.col("decided").isNotNull()), "page_id", "decided", ["ts", "event_id"])
    joined = pages.join(latest.select(F.col("page_id").alias("id"), "decided"), "id", "left")
    return joined.withColumn("verification_status", F.coalesce("decided", "verification_status")).drop("decided")
