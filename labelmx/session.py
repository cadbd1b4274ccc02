"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Run-time re-planning joins small parts of an exchange up to so many bytes. A hash table over them takes about ten times
#: as much, and one task may hold several.
PART_BYTES = 8 << 20
_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def tune(spark: SparkSession) -> SparkSession:
    """Turn on run-time re-planning; every setting can be changed on a live session."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split a skewed join side even if the next aggregation must shuffle again
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if _SIZE not in spark.conf.getAll:  # a size that the session names stays
        spark.conf.set(_SIZE, str(PART_BYTES))
    return spark
