"""Row by row Python over whole texts, in Arrow batches; the id column passes through untouched, nulls included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TEXTS_AT_ONCE = 256


def map_values(
    rows: DataFrame, id_col: str, value_col: str, work: Callable[[list], list[tuple]], schema: str, id_name: str = "doc_id"
) -> DataFrame:
    """``id_name`` and the columns of ``schema`` per row; ``work`` gets at most TEXTS_AT_ONCE values and returns a tuple for each."""
    rows = rows.select(F.col(f"`{id_col}`").alias(id_name), F.col(f"`{value_col}`").alias("value"))
    added: StructType = StructType.fromDDL(schema)
    full = StructType([rows.schema[id_name], *added.fields])
    arrow = to_arrow_schema(full)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                found = work(batch.column(1).to_pylist())
                columns = [pa.array(c, type=f.type) for c, f in zip(zip(*found), list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow.field(0).type), *columns], schema=arrow)

    return rows.mapInArrow(per_batch, full)
