"""Exact deduplication: group by a 128-bit content hash, compare the bytes inside each group, keep one id.

Grouping keys are the hash and the text itself, so rows of one class are equal byte for byte and a hash collision
makes two classes. Copies met by one task are combined before the shuffle: a text that a third of all rows hold
leaves each task once. The classes (hash, kept id, size) are written without their texts and joined back to the
rows on the hash; the optimizer may split that join where one hash is frequent.

Defined cases: a null text counts as empty; an empty table gives no rows; a null id is counted in its group but is
kept only where the whole group has none; repeated rows of one id share one verdict in ``classes`` and become one
row in ``survivors``. Other columns pass through ``survivors`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposight.session import materialise


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _body(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), _body(text_col).alias("body")).withColumn("hash", digest(F.col("body")))
    grouped = rows.groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = materialise(
        grouped.select("hash", "keep_id", "group_size", F.sha2("body", 256).alias("text_sha256")), "exact-classes"
    )
    collided = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    if collided.isEmpty():
        joined = rows.select("doc_id", "hash").join(found, "hash")
    else:  # different texts under one hash: these few meet on the text as well
        odd = rows.join(collided, "hash", "left_semi")
        by_text = odd.groupBy("hash", "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        by_text = by_text.withColumn("text_sha256", F.sha2("body", 256))
        same = odd.join(by_text, ["hash", "body"]).drop("body")
        plain = rows.select("doc_id", "hash").join(found.join(collided, "hash", "left_anti"), "hash")
        joined = plain.unionByName(same)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, by one shuffle."""
    pick = {"smallest": F.min_by, "largest": F.max_by}[keep]
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("no_text"), *others)
    missing_last = F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull()
    order = F.struct(missing_last.alias("missing"), F.col(id_col).alias("id"))
    keyed = docs.select(_body(text_col).alias("body"), row.alias("row"), order.alias("order"))
    grouped = keyed.groupBy(content_hash(F.col("body")).alias("hash"), "body").agg(pick("row", "order").alias("row"))
    back = [
        F.when(~F.col("row.no_text"), F.col("body")).alias(c) if c == text_col else F.col(f"row.c{i}").alias(c)
        for i, c in enumerate(docs.columns)
    ]
    return grouped.select(*back)
