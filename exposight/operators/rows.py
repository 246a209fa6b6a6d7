"""Row selection by key: keep-first, first k, latest; keyed inserts, updates, deletes.

Reference tables are updated in place; here changes are appended as event rows
and the current state is the latest event per key.

``row_number() <= k`` filters are cut down on the map side (Spark's window group
limit), and ``max_by`` has a partial step, so a key holding a third of all rows
reaches its reducer as a few rows per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every key; nulls in keys are equal to each other."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", number).where(F.col("_row") <= k).drop("_row")


def latest_per_key(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``key, value, n_events, last_order``: the value of the latest event and how many there were."""
    latest = F.struct(*order)
    return events.groupBy(key).agg(
        F.max_by(value, latest).alias(value),
        F.count("*").alias("n_events"),
        F.max(order[0]).alias("last_" + order[0]),
    )


def insert_or_ignore(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet; append them to the table."""
    return new.join(existing.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New state of a table: an incoming row replaces the stored one with its key.

    Columns the incoming row leaves null keep their stored value. Of several
    incoming rows with one key the last by ``order`` counts.
    """
    last = first_per_key(incoming, [key], [F.col(c).desc() for c in order])
    fresh = last.select(key, *[F.col(c).alias("_new_" + c) for c in last.columns if c != key])
    joined = stored.join(fresh, key, "full_outer")
    columns = [
        F.coalesce(F.col("_new_" + c), F.col(c)).alias(c) if c in last.columns and c != key else F.col(c)
        for c in stored.columns
    ]
    return joined.select(*columns)


def without_parents(child: DataFrame, removed: DataFrame, child_key: str, removed_key: str) -> DataFrame:
    """Child rows that stay when the parents in ``removed`` are deleted."""
    gone = removed.select(F.col(removed_key).alias(child_key))
    return child.join(gone, child_key, "left_anti").select(*child.columns)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column_name, n_null``, one pass."""
    columns = columns or df.columns
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.sum(F.col(c).isNull().cast("bigint")), F.lit(0).cast("bigint")).alias("n_null"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, filled and empty counts, smallest and largest value as text."""
    rows = []
    for f in df.schema.fields:
        c = F.col(f.name)
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count(c).alias("n_filled"),
                (F.count("*") - F.count(c)).alias("n_null"),
                F.min(c).cast("string").alias("smallest"),
                F.max(c).cast("string").alias("largest"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column))


def dedup_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after keep-first, and how many go."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_before"), F.count("*").alias("n_after")
    ).withColumn("n_removed", F.col("n_before") - F.col("n_after"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
