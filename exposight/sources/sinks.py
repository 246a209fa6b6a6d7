"""Table and CSV sinks. Tables are appended to, never rewritten while being read."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.operators.rows import insert_or_ignore

# Files of one folder: a listing then takes as many tasks as there are thousands of files.
FOLDER_FILES = 1000


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch: int | str) -> None:
    """Write one batch of a table to its own ``batch=`` folder. A repeated batch replaces what it wrote before, so
    nothing stored has to be read; the table is read with a column ``batch``."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose key the table does not hold; a re-run adds nothing. Reads the keys of the whole table."""
    spark = df.sparkSession
    try:
        stored = spark.read.schema(df.schema).parquet(path)
        df = insert_or_ignore(df.dropDuplicates(keys), stored, keys)
    except Exception as error:  # no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        df = df.dropDuplicates(keys)
    df.write.mode("append").parquet(path)


def save_bucketed(df: DataFrame, table: str, key: str, n_buckets: int) -> None:
    """Save bucketed and sorted by ``key``: joins on the key between such tables need no shuffle."""
    df.write.mode("append").bucketBy(n_buckets, key).sortBy(key).saveAsTable(table)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def write_files(df: DataFrame, path: str, key: str, text: str) -> None:
    """One text file per key and task, ``<folder>/<key>=<value>-<task>.txt``: each text and a line end, as ``write.text``
    has them.

    Spark's own writer takes a folder and a commit per key. Folders here hold FOLDER_FILES files, and a file gets its
    name once it is whole: names are the same for every attempt of a task, names that Spark's readers skip until then.
    ``path`` must be one that pyarrow can write.
    """

    def write(batches):
        local = "://" not in path and not path.startswith("file:")
        store, root = (fs.LocalFileSystem(), path) if local else fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        rows = (r for b in batches for r in zip(b.column("name").to_pylist(), b.column("content").to_pylist()))
        n = 0
        for name, same in groupby(rows, lambda r: r[0]):
            folder = f"{root}/{task.partitionId():05d}-{n // FOLDER_FILES:05d}"
            if n % FOLDER_FILES == 0:
                store.create_dir(folder, recursive=True)
            unfinished = f"{folder}/_{task.taskAttemptId()}"
            with store.open_output_stream(unfinished) as file:
                for _, content in same:
                    file.write((content or b"") + b"\n")
            store.move(unfinished, f"{folder}/{name}-{task.partitionId():05d}.txt")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("none")))
    rows = df.sortWithinPartitions(key).select(name.alias("name"), F.col(text).cast("binary").alias("content"))
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()
