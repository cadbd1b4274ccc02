"""Durable working storage: checkpoints and written tables on the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors share one disk, may fall back to a temporary folder.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="labelmx-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def new_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that no earlier run has used."""
    return f"{work_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Replace the lineage of ``df`` by a reliable checkpoint."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, stem: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For axis-sized tables that many plans reuse: it is computed once, survives
    lost executors, and its file sizes let Spark choose the join strategy.
    """
    path = new_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
