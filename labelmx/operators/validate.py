"""Checks and reports on a labeled matrix."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, LabeledMatrix, Matrix, SparseVectors, Table, Vectors
from ..plans.local import small_table

_REPORT = "slot string, element string, problem string, n bigint"


def _key_columns(slot: str, el) -> list[tuple[DataFrame, str, str]]:
    """``(table, column, axis)`` for every axis reference of an element."""
    if isinstance(el, Matrix):
        return [(el.cells, "obs_key", "obs"), (el.cells, "var_key", "var")]
    axis = slot[:3]
    if isinstance(el, Graph):
        return [(el.edges, "i_key", axis), (el.edges, "j_key", axis)]
    return [(el.rows, "key", axis)]


def elements(lm: LabeledMatrix):
    """``(slot, key, element)`` of everything aligned to the axes."""
    if lm.X is not None:
        yield "X", "X", lm.X
    for slot in ("layers", "obsm", "varm", "obsp", "varp"):
        for k, el in getattr(lm, slot).items():
            yield slot, k, el


def _problems(lm: LabeledMatrix, slot: str, key: str, el) -> DataFrame:
    found = []
    for table, col, axis in _key_columns(slot, el):
        held = table.groupBy(F.col(col).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        axis_keys = lm.axis(axis).select("key", F.lit(True).alias("known"))
        # vectors and tables need exactly one row per key, cells and edges any number
        whole = isinstance(el, (Vectors, Table))
        both = held.join(axis_keys, "key", "full" if whole else "left")
        kinds = F.when(F.col("known").isNull(), f"unknown {col}")
        if whole:
            kinds = kinds.when(F.col("n").isNull(), f"missing {col}").when(F.col("n") > 1, f"repeated {col}")
        found.append(both.select(kinds.alias("problem"), F.coalesce("n", F.lit(1)).alias("n")).where("problem IS NOT NULL"))
    if isinstance(el, Matrix):
        twice = el.cells.groupBy("obs_key", "var_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.select(F.lit("repeated cell").alias("problem"), "n"))
    if isinstance(el, SparseVectors):
        twice = el.rows.groupBy("key", "index").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found.append(twice.select(F.lit("repeated entry").alias("problem"), "n"))
        odd = el.rows.where((F.col("index") < 0) | (F.col("index") >= el.width) | F.col("index").isNull())
        found.append(odd.select(F.lit("index out of range").alias("problem"), F.lit(1).cast("bigint").alias("n")))
    if isinstance(el, Vectors):
        odd = el.rows.where(F.size("vec") != el.width)
        found.append(odd.select(F.lit("wrong width").alias("problem"), F.lit(1).cast("bigint").alias("n")))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("problem").agg(F.sum("n").alias("n")).select(
        F.lit(slot).alias("slot"), F.lit(key).alias("element"), "problem", "n"
    )


def unknown_keys(lm: LabeledMatrix, given: Mapping[tuple[str, str], DataFrame] | None = None) -> DataFrame:
    """``(slot, element, problem, n)``: how many distinct keys of each element its axes lack.

    ``given`` has cells as they came, by slot and name: only their own key columns are looked at.

    Keys collapse map-side before they meet the axis, so cells are read once and
    only distinct keys move.
    """
    found = [small_table(lm.spark, [], _REPORT)]
    for slot, name, el in elements(lm):
        own = (given or {}).get((slot, name))
        for table, col, axis in _key_columns(slot, el):
            if own is not None:
                if col not in own.columns:
                    continue  # given by name, which is looked up when the cells are computed
                table = own
            lost = table.select(F.col(col).alias("key")).distinct().join(lm.axis(axis).select("key"), "key", "left_anti")
            counted = lost.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
            found.append(counted.select(F.lit(slot).alias("slot"), F.lit(name).alias("element"), F.lit(f"unknown {col}").alias("problem"), "n"))
    return reduce(DataFrame.unionByName, found)


def check_keys(lm: LabeledMatrix, given: Mapping[tuple[str, str], DataFrame] | None = None) -> None:
    """Raise ``ValueError`` with counts if an element holds keys that its axis lacks; one job for all elements."""
    bad = unknown_keys(lm, given).collect()  # at most two rows per element
    if bad:
        told = "; ".join(f"{r.slot}[{r.element!r}]: {r.n} {r.problem}" for r in bad)
        raise ValueError(f"keys that the axes lack: {told}")


def validate_alignment(lm: LabeledMatrix) -> DataFrame:
    """Every element's misaligned keys: ``(slot, element, problem, n)``; empty when aligned."""
    reports = [_problems(lm, *e) for e in elements(lm)]
    return reduce(DataFrame.unionByName, reports) if reports else small_table(lm.spark, [], _REPORT)


def check_element(lm: LabeledMatrix, slot: str, key: str, el) -> None:
    """Raise ``ValueError`` naming the element if it does not fit the axes."""
    bad = _problems(lm, slot, key, el).collect()
    if bad:
        told = ", ".join(f"{r.n} {r.problem}" for r in bad)
        raise ValueError(f"{slot}[{key!r}] does not align with this labeled matrix: {told}")


def name_mismatches(lm: LabeledMatrix, axis: str, names: DataFrame) -> DataFrame:
    """Positions where ``names(pos, name)`` differs from the axis names."""
    held = lm.positions(axis).select("pos", F.col("name").alias("expected"))
    given = names.select(F.col("pos").cast("bigint").alias("pos"), F.col("name").alias("given"))
    return held.join(given, "pos", "full").where(~F.col("expected").eqNullSafe(F.col("given")))


def duplicate_names(lm: LabeledMatrix, axis: str) -> DataFrame:
    """Names that occur more than once, with their counts."""
    counts = lm.axis(axis).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1)


def element_stats(lm: LabeledMatrix) -> DataFrame:
    """Rows, non-zero values and shape columns of every element, in one report."""
    parts = []
    for slot, key, el in elements(lm):
        if isinstance(el, Matrix):
            agg = el.cells.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
        elif isinstance(el, Graph):
            agg = el.edges.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
        elif isinstance(el, Vectors):
            nz = F.size(F.filter("vec", lambda v: v != 0)).cast("bigint")
            agg = el.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nz), F.lit(0)).alias("n_nonzero"))
        elif isinstance(el, SparseVectors):
            agg = el.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
        else:
            agg = el.rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("bigint").alias("n_nonzero"))
        parts.append(agg.select(F.lit(slot).alias("slot"), F.lit(key).alias("element"), "n_rows", "n_nonzero"))
    for axis in ("obs", "var"):
        n = lm.axis(axis).agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(n.select(F.lit(axis).alias("slot"), F.lit(axis).alias("element"), "n_rows", F.lit(None).cast("bigint").alias("n_nonzero")))
    return reduce(DataFrame.unionByName, parts)
