"""Functional updates; the given labeled matrix is never changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, LabeledMatrix, Matrix, Raw, SparseVectors, Table, Vectors
from ..plans.blocks import key_blocks, spread
from ..plans.durable import cut, new_path
from .build import as_matrix
from .select import resolve
from .validate import check_element


def constant_cells(obs: DataFrame, var: DataFrame, value: Column) -> DataFrame:
    """A cell for every (observation, variable) pair, unfolded from key blocks."""
    rows = obs.select(F.col("key").alias("obs_key"))
    n_vars = var.count()
    grid = spread(rows, key_blocks(var.select("key", "ord"), n_keys=n_vars), n_vars)
    return grid.select("obs_key", F.explode("keys").alias("var_key"), value.alias("value"))


def _is_absent(value, absent) -> bool:
    return value == absent or (value != value and absent != absent)


def set_matrix(lm: LabeledMatrix, value, *, layer: str | None = None, dtype: str | None = None) -> LabeledMatrix:
    """Replace X (or a layer).

    ``value`` is a matrix, a cell table, a scalar for every cell, ``(key, value)``
    rows when the other axis has one name, or ``None`` to remove it.
    """
    def put(m):
        if layer is None:
            return lm.replace(X=m)
        rest = {k: v for k, v in lm.layers.items() if k != layer}
        return lm.replace(layers=rest if m is None else {**rest, layer: m})

    if value is None:
        return put(None)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        old = lm.X if layer is None else lm.layers.get(layer)
        absent = old.absent if old is not None else float("nan")
        cells = constant_cells(lm.obs, lm.var, F.lit(float(value)))
        return put(Matrix(cells.where("false") if _is_absent(value, absent) else cells, absent))
    if isinstance(value, DataFrame) and set(value.columns) == {"key", "value"}:
        n_obs, n_vars = lm.shape
        if 1 not in (n_obs, n_vars):
            raise ValueError(f"a one-dimensional value does not fit shape {(n_obs, n_vars)}")
        long, single = ("obs", "var") if n_vars == 1 else ("var", "obs")
        other = lm.axis(single).first()["key"]
        value = value.select(F.col("key").alias(f"{long}_key"), F.lit(other).alias(f"{single}_key"), "value")
    m = as_matrix(value, lm.obs, lm.var, dtype)
    check_element(lm, "layers" if layer else "X", layer or "X", m)
    return put(m)


def _marked(cells: DataFrame, keys: DataFrame, col: str) -> DataFrame:
    return cells.join(keys.select(F.col("key").alias(col), F.lit(True).alias(f"_{col}")), col, "left")


def assign_block(lm: LabeledMatrix, obs, var, value, *, layer: str | None = None) -> LabeledMatrix:
    """Write a value to the block selected by two indices (their outer product).

    ``value`` is a scalar or a cell table of the block; block cells it lacks
    become absent. Returns the changed parent.
    """
    m = lm.X if layer is None else lm.layers[layer]
    picks = {}
    for axis, index in (("obs", obs), ("var", var)):
        sel = resolve(lm, axis, index)
        if sel is not None and sel.remap is not None:
            picks[axis] = lm.axis(axis).join(sel.remap.select("key"), "key", "left_semi")
        else:
            picks[axis] = lm.axis(axis) if sel is None else sel.table
    marked = _marked(_marked(m.cells, picks["obs"], "obs_key"), picks["var"], "var_key")
    outside = marked.where(F.col("_obs_key").isNull() | F.col("_var_key").isNull())
    kind = m.cells.schema["value"].dataType
    if isinstance(value, DataFrame):
        new = value.join(picks["obs"].select(F.col("key").alias("obs_key")), "obs_key", "left_semi")
        new = new.join(picks["var"].select(F.col("key").alias("var_key")), "var_key", "left_semi")
    else:
        new = constant_cells(picks["obs"], picks["var"], F.lit(float(value)))
        if _is_absent(value, m.absent):
            new = new.where("false")  # the block's cells are absent then
    new = new.select("obs_key", "var_key", F.col("value").cast(kind).alias("value"))
    changed = Matrix(outside.select("obs_key", "var_key", "value").unionByName(new), m.absent)
    return lm.replace(X=changed) if layer is None else lm.replace(layers={**lm.layers, layer: changed})


def _single_cells(lm: LabeledMatrix, cells: DataFrame, kind, order: str | None) -> DataFrame:
    """``(obs_key, var_key, _new)``, one row per coordinate of the axes.

    Of cells given more than once the last by ``order`` counts; without an order
    they raise ``ValueError``, as does a coordinate outside the axes.
    """
    value = F.col("value").cast(kind)
    # in a struct a null value can be the last one too
    last = F.max_by(F.struct(value.alias("v")), order) if order else F.first(F.struct(value.alias("v")))
    new = cells.groupBy("obs_key", "var_key").agg(last.getField("v").alias("_new"), F.count(F.lit(1)).alias("_n"))
    placed = _marked(_marked(new, lm.obs, "obs_key"), lm.var, "var_key")
    outside = F.col("_obs_key").isNull() | F.col("_var_key").isNull()
    bad = placed.agg(F.count_if(outside).alias("outside"), F.count_if(F.col("_n") > 1).alias("repeated")).first()
    if bad.outside:
        raise ValueError(f"{bad.outside} cells lie outside the axes")
    if bad.repeated and not order:
        raise ValueError(f"{bad.repeated} cells are given more than once: name the column that orders them")
    return new.drop("_n")


def assign_cells(lm: LabeledMatrix, cells: DataFrame, *, layer: str | None = None, order: str | None = None) -> LabeledMatrix:
    """Write single cells ``(obs_key, var_key, value)``.

    A coordinate is given once, or its last value by ``order`` counts.
    """
    m = lm.X if layer is None else lm.layers[layer]
    new = _single_cells(lm, cells, m.cells.schema["value"].dataType, order).withColumn("_set", F.lit(True))
    both = m.cells.join(new, ["obs_key", "var_key"], "full")
    value = F.when(F.col("_set"), F.col("_new")).otherwise(F.col("value"))
    changed = Matrix(both.select("obs_key", "var_key", value.alias("value")), m.absent)
    return lm.replace(X=changed) if layer is None else lm.replace(layers={**lm.layers, layer: changed})


def update_existing_only(lm: LabeledMatrix, cells: DataFrame, *, layer: str | None = None, order: str | None = None) -> LabeledMatrix:
    """Write cells that are already stored.

    A non-zero value for a cell that is not stored raises ``ValueError``; a zero
    for such a cell changes nothing. Repeats are treated as in ``assign_cells``.
    """
    m = lm.X if layer is None else lm.layers[layer]
    new = _single_cells(lm, cells, m.cells.schema["value"].dataType, order)
    fresh = new.where(F.col("_new") != 0).join(m.cells, ["obs_key", "var_key"], "left_anti")
    some = fresh.limit(5).collect()
    if some:
        raise ValueError(f"{fresh.count()} cells are not stored, such as {[(r.obs_key, r.var_key) for r in some]}")
    both = m.cells.join(new, ["obs_key", "var_key"], "left")
    changed = Matrix(both.select("obs_key", "var_key", F.coalesce("_new", "value").alias("value")), m.absent)
    return lm.replace(X=changed) if layer is None else lm.replace(layers={**lm.layers, layer: changed})


_SLOTS = {"layers": Matrix, "obsm": (Vectors, SparseVectors, Table), "varm": (Vectors, SparseVectors, Table), "obsp": Graph, "varp": Graph}


def set_element(lm: LabeledMatrix, slot: str, key: str, el) -> LabeledMatrix:
    """Add or replace an element after checking that it fits the axes."""
    if slot not in _SLOTS or not isinstance(el, _SLOTS[slot]):
        raise TypeError(f"{type(el).__name__} cannot be stored in {slot!r}")
    check_element(lm, slot, key, el)
    return lm.replace(**{slot: {**getattr(lm, slot), key: el}})


def drop_element(lm: LabeledMatrix, slot: str, key: str | None = None) -> LabeledMatrix:
    """Remove one element, or all of a slot."""
    held = getattr(lm, slot)
    if key is None:
        return lm.replace(**{slot: {}})
    if key not in held:
        raise KeyError(key)
    return lm.replace(**{slot: {k: v for k, v in held.items() if k != key}})


def _dictionaries(lm: LabeledMatrix, axis: str, col: str) -> dict:
    held = getattr(lm, f"{axis}_categories")
    return {f"{axis}_categories": {k: v for k, v in held.items() if k != col}}


def set_column(lm: LabeledMatrix, axis: str, column: str, value: Column | DataFrame) -> LabeledMatrix:
    """Add or overwrite an annotation column.

    ``value`` is an expression over the axis table, or ``(key, value)`` /
    ``(pos, value)`` rows that must match the axis length.
    """
    table = lm.axis(axis)
    if isinstance(value, Column):
        return lm.replace(**{axis: table.withColumn(column, value)}, **_dictionaries(lm, axis, column))
    on = "key" if "key" in value.columns else "pos"
    n, given = table.count(), value.count()
    if n != given:
        raise ValueError(f"{given} values given for {axis} axis of length {n}")
    source = table if on == "key" else lm.positions(axis, n)
    new = value.select(F.col(on).cast("bigint").alias(on), F.col("value").alias("_value"))
    if source.join(new, on, "left_semi").count() != n:
        raise ValueError(f"the values do not name every row of the {axis} axis once")
    out = source.join(new, on, "left").withColumn(column, F.col("_value")).drop("_value", "pos")
    return lm.replace(**{axis: out}, **_dictionaries(lm, axis, column))


def drop_column(lm: LabeledMatrix, axis: str, column: str) -> LabeledMatrix:
    if column not in lm.axis(axis).columns:
        raise KeyError(column)
    return lm.replace(**{axis: lm.axis(axis).drop(column)}, **_dictionaries(lm, axis, column))


def replace_annotation(lm: LabeledMatrix, axis: str, rows: DataFrame) -> LabeledMatrix:
    """Replace the whole annotation by ``(pos, name, columns…)`` rows, one for every position."""
    n, given = lm.axis(axis).count(), rows.count()
    table = lm.positions(axis, n).select("key", "ord", "pos")
    if n != given:
        raise ValueError(f"{given} rows given for {axis} axis of length {n}")
    cols = [c for c in rows.columns if c not in ("pos", "name")]
    new = rows.withColumn("pos", F.col("pos").cast("bigint")).withColumn("name", F.col("name").cast("string"))
    if table.join(new, "pos", "left_semi").count() != n:  # as many rows as positions: one that is met by none is replaced by a repeat
        raise ValueError(f"the rows do not give every position of the {axis} axis once")
    out = table.join(new, "pos", "left").select("key", "ord", "name", *cols)
    return lm.replace(**{axis: out, f"{axis}_categories": {}})


def snapshot_raw(lm: LabeledMatrix, source: LabeledMatrix | None) -> LabeledMatrix:
    """Freeze ``source``'s X, variables and variable vectors as raw; ``None`` removes raw."""
    if source is None:
        return lm.replace(raw=None)
    if not isinstance(source, LabeledMatrix):
        raise ValueError("raw can only be set from a labeled matrix")
    return lm.replace(raw=Raw(source.X, source.var, source.varm, source.var_dense))


def materialize(lm: LabeledMatrix, path: str | None = None) -> LabeledMatrix:
    """Compute every element once: stored at ``path``, or in the shared work folder."""
    from ..sources.bundle import read_bundle, write_bundle

    target = path or new_path(lm.spark, "matrix")
    write_bundle(lm, target, strings_to_categories=False)
    return read_bundle(lm.spark, target)


def checkpointed(m: Matrix) -> Matrix:
    """The matrix with its lineage cut by a reliable checkpoint."""
    return Matrix(cut(m.cells), m.absent)
