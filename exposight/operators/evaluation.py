"""Classification report, mistakes, class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, n, weight`` with weight ``rows / (classes * rows of the class)``."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    # One row per class by now, so a window over all of them is small and needs no second scan.
    classes = Window.partitionBy(F.lit(1))
    weight = F.sum("n").over(classes).cast("double") / (F.count("*").over(classes) * F.col("n"))
    return counts.select("label", "n", weight.alias("weight"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)


def class_counts(predictions: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """``label, hits, n_predicted, support``: all that the report needs, one row per class.

    Rows are counted per (actual, predicted) first; everything after works on
    those few counts.
    """
    cells = predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("n_predicted")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("n_predicted")),
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("support")).otherwise(0)
    counts = (
        cells.select("actual", "predicted", F.inline(sides))
        .groupBy("label")
        .agg(F.sum(hit).alias("hits"), F.sum("n_predicted").alias("n_predicted"), F.sum("support").alias("support"))
    )
    if labels is None:
        return counts
    given = predictions.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    joined = given.join(counts, "label", "left")
    return joined.select("label", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("hits", "n_predicted", "support")])


def classification_report(predictions: DataFrame, labels: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """``label, precision, recall, f1_score, support`` per class, then accuracy and the averages.

    Undefined ratios are 0. ``labels`` fixes the classes; otherwise they are those
    seen on either side. ``digits`` rounds half to even.
    """
    counts = class_counts(predictions, labels)
    precision = _ratio(F.col("hits"), F.col("n_predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    rated = counts.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1_score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    metrics = ["precision", "recall", "f1_score"]
    accuracy = _ratio(F.sum("hits"), F.sum("support"))
    weighted = {m: _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in metrics}
    total = F.sum("support").alias("support")
    summary = rated.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), *[accuracy.alias(m) for m in metrics], total),
            F.struct(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in metrics], total),
            F.struct(F.lit("weighted avg").alias("label"), *[weighted[m].alias(m) for m in metrics], total),
        ).alias("r")
    ).select(F.inline("r"))
    report = rated.select("label", *metrics, "support").unionByName(summary)
    if digits is None:
        return report
    return report.withColumns({m: F.bround(m, digits) for m in metrics})


def mistakes(predictions: DataFrame, mails: DataFrame) -> DataFrame:
    """Wrong predictions with the sender's domain; only wrong rows reach the join."""
    wrong = predictions.where(F.col("actual") != F.col("predicted")).select("email_id", "actual", "predicted")
    domains = mails.select(F.col("id").alias("email_id"), "sender_email_domain")
    return wrong.join(domains, "email_id")
