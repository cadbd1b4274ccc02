"""Small driver-side lists as tables, without starting Python workers."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The column types used for such lists.
_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "array<string>": pa.list_(pa.string()),
}


def small_table(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A table of ``rows`` for a schema such as ``"key bigint, name string"``."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    columns = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[name for name, _ in fields]))
