"""What the corpus operators share: reading tables, free column names, bounded collects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

#: A batch that Spark sends to Python ends at so many bytes (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators: rows go to Python in batches of few bytes, as texts may be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, so extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def task_count(df: DataFrame, per_task: int = 1) -> int:
    """Partitions for a keyed exchange: the session's setting, so clusters can size it."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // per_task)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def fold(doc_id: Column, modulus: int) -> Column:
    """Fold of a document: crc32 of its id as text, modulo ``modulus`` (null ids count as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def chunks(sizes: Iterable[int], limit: int) -> list[tuple[int, int]]:
    """Cut consecutive rows into ranges of at most ``limit`` bytes, a larger row alone."""
    out, start, total, i = [], 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            out.append((start, i))
            start, total = i, 0
        total += n
    if i >= 0:
        out.append((start, i + 1))
    return out
