"""What the training-data operators share: reading, storing intermediate tables, and running Python over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slatewise.session import work_folder


#: Rows turned into Python objects at once.
ROWS_AT_ONCE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to the shared folder of ``spark.checkpoint.dir``: it is computed once, its rows are fixed,
    and an executor lost later costs nothing but a second read."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(name: str = "text") -> "F.Column":
    """UTF-8 bytes of a text column; null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"")).alias(name)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Apply a function of the batch's columns (as Python lists) that returns result rows.

    ``make`` runs once per task and returns that function, so tables are built once and not per batch.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = function(*[column.to_pylist() for column in batch.slice(start, ROWS_AT_ONCE).columns])
                columns: list[Any] = list(zip(*rows)) if rows else [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)
