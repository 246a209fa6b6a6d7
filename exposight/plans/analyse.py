"""Page analysis: pending pages to findings and risk scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.operators import matching


def pending_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("verification_status") == "pending").select("page_id", "extracted_text")


def analyse_pages(
    pages: DataFrame, terms: DataFrame, points: dict[str, int] = fv.RISK_POINTS, phone_mode: str = "page_digits"
) -> DataFrame:
    """``page_id, subject_id, n_findings, risk_score`` of every pending page."""
    pending = pending_pages(pages)
    found = matching.findings(pending, terms, phone_mode=phone_mode)
    return matching.page_risk(pending, matching.risk_scores(found, points))
