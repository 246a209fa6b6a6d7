"""Stratified split with exact class quotas, without sorting a whole class in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.session import materialise

_BUCKET_DIGITS = 4  # hexadecimal digits of the draw: 65,536 buckets per class


def class_quotas(counts: DataFrame, share: tuple[int, int] = fv.HELD_OUT_SHARE) -> DataFrame:
    """``label, n, n_test``: ``ceil(share * rows)`` held-out rows, spread over the classes in proportion.

    Training places go by largest remainder (ties by label); the rest is held out.
    """
    part, whole = share
    # One row per class, so windows over all of them are small.
    everything = Window.partitionBy(F.lit(1))
    rows = F.sum("n").over(everything).cast("decimal(18,0)")
    sized = counts.select("label", "n", rows.alias("_rows"))
    n_train = F.col("_rows") - F.ceil(F.col("_rows") * part / whole)
    places = F.col("n").cast("decimal(18,0)") * n_train.cast("decimal(18,0)")
    quota = sized.withColumns(
        {"_floor": F.floor(places / F.col("_rows")).cast("bigint"), "_n_train": n_train.cast("bigint")}
    ).withColumn("_rest", places - F.col("_floor").cast("decimal(18,0)") * F.col("_rows"))
    by_rest = everything.orderBy(F.desc("_rest"), F.asc("label"))
    extra = F.row_number().over(by_rest) <= F.col("_n_train") - F.sum("_floor").over(everything)
    n_in_train = F.col("_floor") + extra.cast("bigint")
    return quota.select("label", "n", (F.col("n") - n_in_train).alias("n_test"))


def _cuts(draws: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``label, cut``: per class the last (draw, key) that is held out; no row for a class that holds out none.

    A histogram over the leading digits of the draw shows in which bucket a
    class's quota ends; only the rows inside it, 1 in 65,536, are ranked.
    """
    histogram = draws.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    quotas = class_quotas(histogram.groupBy("label").agg(F.sum("n").alias("n")), share)
    before = F.sum("n").over(Window.partitionBy("label").orderBy("bucket")) - F.col("n")
    # Bounded by classes x 65,536 rows; one bucket per class comes out.
    ends = (
        histogram.withColumn("before", before)
        .join(quotas.select("label", "n_test"), "label")
        .where((F.col("before") < F.col("n_test")) & (F.col("before") + F.col("n") >= F.col("n_test")))
        .select("label", "bucket", (F.col("n_test") - F.col("before")).alias("open"))
    )
    rank = F.row_number().over(Window.partitionBy("label").orderBy("place"))
    inside = draws.join(ends, ["label", "bucket"]).withColumn("rank", rank)
    return inside.where(F.col("rank") == F.col("open")).select("label", F.col("place").alias("cut"))


def stratified_split(
    df: DataFrame, key: str, label: str, seed: int = fv.SPLIT_SEED, share: tuple[int, int] = fv.HELD_OUT_SHARE
) -> DataFrame:
    """Add ``is_test``. Each class holds out its quota of rows with the smallest ``md5(key || seed)``.

    Keys are unique. The cuts are found from keys and labels alone and written;
    whole rows are then compared with them, without a shuffle.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    place = F.struct(draw.alias("draw"), F.col(key).alias("key"))
    bucket = F.conv(F.left(draw, F.lit(_BUCKET_DIGITS)), 16, 10).cast("int")
    draws = df.select(F.col(label).alias("label"), place.alias("place"), bucket.alias("bucket"))
    # One row per class, written so that its size is known when the join is planned.
    cuts = materialise(_cuts(draws, share), "split-cuts").select(F.col("label").alias(label), F.col("cut").alias("_cut"))
    held_out = F.coalesce(place <= F.col("_cut"), F.lit(False))
    return df.join(cuts, label, "left").withColumn("is_test", held_out).drop("_cut")
