"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are put in a fixed random order (by a hash of their id) and given a virtual finish time: the
source's words up to and including the document, divided by the source's target. A source whose target is above its
size queues whole further copies behind the first. All queued copies are then sorted by range on the finish time and
cut where the total budget ends.

Running totals never need one task per source: ids are dealt into buckets of their hash, bucket totals are summed
first, and each bucket adds what lies before it. The cut is found from one total per sorted range and the rows of
the one range in which the budget ends.

Defined cases: a null text has size 0; a document without words is never taken; a source without words has target
0; a null source is a source of its own, ordered last; a null id is ordered like an empty one; repeated rows queue
one by one and each gets its own row; an empty table gives no rows. The table of sources is one row per source, as
long as the caller's list of weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exposight.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 256  # aimed at, per source and bucket
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def with_targets(sources: DataFrame, weights: tuple[int, ...], max_copies: int = MAX_COPIES) -> DataFrame:
    """``source, source_size`` → the same with ``rank, target``. Shares of the whole by weight, none above
    ``max_copies`` times its size; what the limit frees goes to the others by weight."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights) + 1).cast("bigint")
    ranked = sources.select("source", "source_size", rank.alias("rank"), weight.alias("weight"))
    limit = F.col("source_size") * max_copies
    fullest = Window.orderBy(limit / F.col("weight"), "rank")
    before = fullest.rowsBetween(Window.unboundedPreceding, -1)
    after = fullest.rowsBetween(0, Window.unboundedFollowing)
    whole = F.sum("source_size").over(Window.partitionBy())
    level = (whole - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(after)
    levelled = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= limit / F.col("weight"))
    reached = F.min(F.when(F.col("fits"), F.struct(limit / F.col("weight"), "rank", "level"))).over(Window.partitionBy())
    target = F.least(limit.cast("double"), reached["level"] * F.col("weight"))
    return levelled.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_copies: int = MAX_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, source_size, target, taken, copies``."""
    sized = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))).alias("shuffle"),
        ),
        "mix-sizes",
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    targets = with_targets(per_source, weights, max_copies).withColumnRenamed("source", "s")
    known = per_source.select("source", buckets.alias("buckets")).join(
        targets, F.col("source").eqNullSafe(F.col("s"))
    )
    known = materialise(known.drop("s").withColumnRenamed("source", "s"), "mix-sources")

    # Position in the source's queue.
    place = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("bigint")
    rows = sized.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("bucket", F.floor(place * F.col("buckets") / F.lit(float(1 << 32))))
    totals = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("rank", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("rank", "bucket").orderBy("shuffle", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("inside", F.sum("size").over(inside)).join(totals, ["rank", "bucket"])
    queued = queued.select(
        "doc_id", "size", "source_size", "target", "rank", (F.col("offset") + F.col("inside")).alias("position")
    )
    queued = materialise(queued, "mix-queue")

    cut = _cut(queued, max_copies)
    copies = F.lit(0)
    if cut is not None:
        for copy in range(max_copies):
            taken = (F.col("size") > 0) & (_key(F.lit(copy)) <= cut)
            copies = copies + F.when(taken, 1).otherwise(0)
    return queued.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("bigint").alias("taken"), copies.alias("copies"))


def _key(copy: Column) -> Column:
    """Order of the fair queue: finish time, then names for ties."""
    finish = (copy * F.col("source_size") + F.col("position")) / F.col("target")
    return F.struct(
        finish.alias("finish"), F.col("rank").cast("int").alias("rank"),
        F.col("position").cast("bigint").alias("position"), copy.cast("int").alias("copy"),
    )


def _cut(queued: DataFrame, max_copies: int) -> Column | None:
    """Key of the last copy within the budget, the whole of all sizes; None if there is none."""
    # All copies: sources lag their targets by parts of documents, so the cut may lie in a copy beyond the target.
    copies = queued.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_copies - 1))))
    keyed = copies.select(_key(F.col("copy")).alias("key"), "size")
    ranged = keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "mix-ranges")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("words"), F.max("key").alias("last"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("upto", F.sum("words").over(upto))  # one row per range
    budget = queued.agg(F.sum("size")).first()[0] or 0
    whole = parts.where(F.col("upto") <= budget).agg(F.max(F.struct("last", "upto")).alias("m")).first()["m"]
    begun = whole["upto"] if whole else 0
    split = parts.where(F.col("upto") > budget).agg(F.min("part")).first()[0]
    last = whole["last"] if whole else None
    if split is not None:
        running = F.sum("size").over(Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
        within = ranged.where(F.col("part") == split).withColumn("running", running).where(F.col("running") <= budget - begun)
        last = within.agg(F.max("key")).first()[0] or last
    if last is None:
        return None
    return F.struct(
        F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).cast("int").alias("rank"),
        F.lit(last["position"]).cast("bigint").alias("position"), F.lit(last["copy"]).cast("int").alias("copy"),
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept. Rows that share an id are taken
    equally often."""
    taken = mix(docs, weights, id_col=id_col, **options).groupBy("doc_id").agg(F.max("copies").alias("copies"))
    taken = taken.where("copies > 0").select(F.col("doc_id").alias("mix_id"), F.sequence(F.lit(1), "copies").alias("mix_copies"))
    joined = docs.alias("d").join(taken.alias("m"), F.col(f"d.{id_col}").eqNullSafe(F.col("m.mix_id")))
    every = [F.col(f"d.`{c}`") for c in docs.columns]
    return joined.select(*every, F.explode("m.mix_copies").alias("one more")).select(*[f"`{c}`" for c in docs.columns])
