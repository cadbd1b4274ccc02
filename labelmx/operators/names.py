"""Axis names: making them unique, replacing them."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import LabeledMatrix
from ..plans.ranks import ranked, running_total, whole_div


def taken_suffixes(table: DataFrame, join: str) -> DataFrame:
    """``(name, _t)``: numbers that names in use already put behind a repeated name and ``join``."""
    pattern = f"(?s)^(.*){re.escape(join)}([1-9][0-9]{{0,17}})$"
    repeated = table.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", "n")
    hits = repeated.where(F.col("name").rlike(pattern)).select(
        F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).cast("bigint").alias("_t")
    )
    return hits.withColumnRenamed("base", "name").join(repeated.where("n > 1").select("name"), "name", "left_semi")


def unique_names(table: DataFrame, join: str = "-", *, rows_per_bucket: int | None = None) -> DataFrame:
    """Axis table with repeated names made unique.

    The first occurrence keeps its name; the i-th later one becomes
    ``name + join + k`` with k counting up from 1 and skipping every
    ``name + join + k`` that already exists. With the taken numbers t1 < t2 < …
    of a name, the i-th free number is ``i + #{j : tj - j < i}``, so the skips are
    a running count along i and a very frequent name needs no single task.
    """
    if not join or join[-1].isdigit():
        raise ValueError("join must be non-empty and must not end in a digit")
    rpb = {"rows_per_bucket": rows_per_bucket}
    numbered = ranked(table, "ord", "_i", ["name"], **rpb)

    taken = taken_suffixes(table, join)
    # free numbers below the j-th taken one: t - j; equal ones are summed first
    skips = (
        ranked(taken, "_t", "_j", ["name"], **rpb)
        .groupBy("name", (F.col("_t") - F.col("_j") - 1).alias("_i"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    later = numbered.where("_i > 0")
    # a skip at free number u applies to every i > u; order skips before rows of the next i
    events = later.select("name", (F.col("_i") * 2).alias("_e"), F.lit(0).cast("bigint").alias("_n"), "key").unionByName(
        skips.select("name", (F.col("_i") * 2 + 1).alias("_e"), "_n", F.lit(None).cast("bigint").alias("key"))
    )
    shifted = running_total(events, "_e", F.col("_n"), "_skip", ["name"], **rpb)
    suffix = shifted.where("key IS NOT NULL").select("key", (whole_div(F.col("_e"), 2) + F.col("_skip")).alias("_k"))
    renamed = F.when(F.col("_k").isNull(), F.col("name")).otherwise(
        F.concat("name", F.lit(join), F.col("_k").cast("string"))
    )
    return table.join(suffix, "key", "left").select(*[renamed.alias("name") if c == "name" else F.col(c) for c in table.columns])


def make_names_unique(lm: LabeledMatrix, axis: str, join: str = "-") -> LabeledMatrix:
    """Repeated names get a number; a warning tells if names in use look like numbered ones."""
    like = taken_suffixes(lm.axis(axis), join).limit(5).collect()
    if like:
        shown = ", ".join(sorted(f"{r.name}{join}{r._t}" for r in like))
        warnings.warn(f"{axis} already holds names that look numbered, such as {shown}; the new ones may be mistaken for them", UserWarning, stacklevel=2)
    return lm.replace(**{axis: unique_names(lm.axis(axis), join)})


def set_names(lm: LabeledMatrix, axis: str, names: Column | DataFrame) -> LabeledMatrix:
    """Replace axis names by an expression, or by ``(key, name)`` / ``(pos, name)`` rows."""
    table = lm.axis(axis)
    if isinstance(names, Column):
        return lm.replace(**{axis: table.withColumn("name", names.cast("string"))})
    n, given = table.count(), names.count()
    if n != given:
        raise ValueError(f"{given} names given for {axis} axis of length {n}")
    on = "key" if "key" in names.columns else "pos"
    source = table if on == "key" else lm.positions(axis, n)
    new = names.select(F.col(on).cast("bigint").alias(on), F.col("name").cast("string").alias("_name"))
    if source.join(new, on, "left_semi").count() != n:
        raise ValueError(f"the names do not name every row of the {axis} axis once")
    out = source.join(new, on, "left")
    return lm.replace(**{axis: out.select(*[F.col("_name").alias("name") if c == "name" else F.col(c) for c in table.columns])})
