"""Reading values: vectors along an axis, matrix choice, wide tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import inflate
from ..model import LabeledMatrix, Matrix, annotation
from ..plans.blocks import BLOCK_WIDTH
from ..plans.durable import stored
from ..plans.local import small_table
from ..plans.ranks import whole_div
from .select import _single, raw_matrix


def pick_matrix(lm: LabeledMatrix, *, layer: str | None = None, use_raw: bool = False) -> Matrix:
    """X, a layer, or raw's X."""
    if use_raw and layer is not None:
        raise ValueError("give either a layer or use_raw, not both")
    if use_raw:
        if lm.raw is None:
            raise ValueError("this labeled matrix has no raw")
        return lm.raw.X
    if layer is not None:
        return lm.layers[layer]
    if lm.X is None:
        raise ValueError("this labeled matrix has no X")
    return lm.X


def matrix_vector(lm: LabeledMatrix, axis: str, name: str, *, layer: str | None = None) -> DataFrame:
    """``(key, ord, name, value)`` along ``axis`` for one name of the other axis.

    The name is looked up first, so the matrix scan filters on a literal key.
    """
    other = "var" if axis == "obs" else "obs"
    key = _single(lm.axis(other), name)
    m = pick_matrix(lm, layer=layer)
    column = m.cells.where(F.col(f"{other}_key") == key).select(F.col(f"{axis}_key").alias("key"), "value")
    table = lm.axis(axis).select("key", "ord", "name")
    return table.join(column, "key", "left").withColumn("value", F.coalesce("value", F.lit(m.absent)))


def vector(lm: LabeledMatrix, axis: str, key: str, *, layer: str | None = None) -> DataFrame:
    """One value per row of ``axis``: an annotation column, or a matrix slice.

    A key found both as annotation column and as a name of the other axis is
    ambiguous (``ValueError``); one found in neither raises ``KeyError``.
    """
    other = "var" if axis == "obs" else "obs"
    table = lm.axis(axis)
    in_columns = key in annotation(table)
    in_names = not lm.axis(other).where(F.col("name") == key).isEmpty()
    if in_columns and in_names:
        raise ValueError(f"{key!r} is both a column of {axis} and a name of {other}")
    if in_columns:
        return table.select("key", "ord", "name", F.col(key).alias("value"))
    if not in_names:
        raise KeyError(f"{key!r} is neither a column of {axis} nor a name of {other}")
    return matrix_vector(lm, axis, key, layer=layer)


def raw_vector(lm: LabeledMatrix, axis: str, key: str) -> DataFrame:
    """A vector from raw: observations by raw variable name only, variables also by column."""
    nested = raw_matrix(lm)
    if axis == "obs":
        nested = nested.replace(obs=nested.obs.select("key", "ord", "name"))
    return vector(nested, axis, key)


def _named_places(lm: LabeledMatrix, columns: Sequence[str], axis: str = "var") -> DataFrame:
    """``(key, pos)`` of the given names, numbered as they are listed; each must be held exactly once."""
    if len(set(columns)) != len(columns):
        raise ValueError("columns must be given once each")
    given = small_table(lm.spark, [(c, i) for i, c in enumerate(columns)], "name string, pos bigint")
    found = lm.axis(axis).join(F.broadcast(given), "name").select("key", "pos")  # as long as the caller's list
    places = stored(found, "columns")
    if places.count() != len(columns) or places.select("pos").distinct().count() != len(columns):
        raise KeyError(f"{axis} does not hold each of the given columns exactly once")
    return places


def _sql_number(x: float) -> str:
    return "double('NaN')" if math.isnan(x) else f"double('{x!r}')"


def to_wide(
    lm: LabeledMatrix, layer: str | None = None, *, use_raw: bool = False, columns: Sequence[str] | None = None, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Names × names table: ``name`` plus one column per variable, or per name in ``columns``.

    A row's cells are packed once into dense blocks of ``width`` columns, and a
    column is a place in a block, so the number of aggregates grows with the blocks
    and not with the columns. Columns are part of the plan: their names are the
    caller's, or are collected if none are given. ``reshape.pack_dense`` keeps rows
    as arrays where an axis is too wide for columns at all.
    """
    if use_raw:
        m, held = pick_matrix(lm, layer=layer, use_raw=True), raw_matrix(lm)
    else:
        m, held = pick_matrix(lm, layer=layer), lm
    if columns is None:
        listed = [(r.key, r.name) for r in held.var.orderBy("ord").select("key", "name").collect()]
        names = [n for _, n in listed]
        places = held.positions("var", len(names)).select("key", "pos")
    else:
        names, places = list(columns), _named_places(held, columns)
    table = lm.obs.select("key", "ord", "name")
    if not names:
        return table.select("name")
    n_blocks = -(-len(names) // width)
    cells = m.cells.join(places.withColumnRenamed("key", "var_key"), "var_key")
    cells = cells.select(F.col("obs_key").alias("key"), whole_div(F.col("pos"), width).alias("block"), F.pmod("pos", F.lit(width)).cast("int").alias("off"), "value")
    item = F.struct("off", "value")
    rows = cells.groupBy("key").agg(*[F.sort_array(F.collect_list(F.when(F.col("block") == b, item))).alias(f"_b{b}") for b in range(n_blocks)])
    size = lambda b: min(width, len(names) - b * width)
    rows = rows.select("key", *[inflate(F.col(f"_b{b}"), size(b), m.absent).alias(f"_b{b}") for b in range(n_blocks)])
    quoted = lambda n: "`" + n.replace("`", "``") + "`"
    none = _sql_number(m.absent)
    wide = table.select("key", F.col("name").alias("_name")).join(rows, "key", "left")
    return wide.selectExpr("_name AS name", *[f"coalesce(get(_b{i // width}, {i % width}), {none}) AS {quoted(n)}" for i, n in enumerate(names)])
