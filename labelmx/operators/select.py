"""Aligned selection along both axes.

A selection is either a *filter* (keys and order unchanged: predicates, masks,
slices) or a *gather* (a list with its own order and repeats, which gives new
keys). Every element then follows by one join on the axis key; selections on
both axes combine as an outer product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Categories, Graph, LabeledMatrix, Matrix, Raw, SparseVectors, Table, Vectors, is_text
from ..plans.durable import new_path, stored
from ..plans.local import small_table
from ..plans.ranks import numbered, ranked


@dataclass(frozen=True)
class Selection:
    """The surviving axis table; ``remap`` is ``(key, new_key)`` if keys change."""

    table: DataFrame
    remap: DataFrame | None = None
    dense: bool = False

    @property
    def keys(self) -> DataFrame:
        return self.table.select("key")


# -- resolving an index to a selection ---------------------------------------------


def _gather(axis: DataFrame, picked: DataFrame) -> Selection:
    """Selection from ``(new_key, <axis columns>)`` rows."""
    cols = [c for c in axis.columns if c not in ("key", "ord")]
    table = picked.select(F.col("new_key").alias("key"), F.col("new_key").alias("ord"), *cols)
    return Selection(table, picked.select("key", "new_key"), dense=True)


def by_labels(axis: DataFrame, labels: DataFrame) -> Selection:
    """Rows named in ``labels(name, new_key)``, in the order of the list.

    One job checks the list: a missing label raises ``KeyError`` naming the
    first few, a label that names several rows raises ``ValueError``.
    """
    wanted = labels.select(F.col("name").cast("string").alias("name"), F.col("new_key").cast("bigint").alias("new_key"))
    held = axis.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    found = wanted.join(held, "name", "left")
    missing, repeated = F.col("n").isNull(), F.col("n") > 1
    bad = found.agg(F.count_if(missing).alias("missing"), F.count_if(repeated).alias("repeated")).first()
    some = lambda cond: sorted({str(r.name) for r in found.where(cond).select("name").limit(20).collect()})
    if bad.missing:
        raise KeyError(f"{bad.missing} names not found, such as {some(missing)}")
    if bad.repeated:
        raise ValueError(f"{bad.repeated} names repeat on this axis, such as {some(repeated)}")
    return _gather(axis, axis.join(wanted, "name"))


def by_positions(placed: DataFrame, positions: DataFrame, n: int) -> Selection:
    """Rows at ``positions(pos, new_key)``; any order, repeats allowed."""
    wanted = positions.select(F.col("pos").cast("bigint").alias("pos"), F.col("new_key").cast("bigint").alias("new_key"))
    wanted = wanted.withColumn("pos", F.when(F.col("pos") < 0, F.col("pos") + n).otherwise(F.col("pos")))
    outside = wanted.where(~F.col("pos").between(0, n - 1)).limit(5).collect()
    if outside:
        raise IndexError(f"positions out of range for size {n}: {[r.pos for r in outside]}")
    return _gather(placed.drop("pos"), placed.join(wanted, "pos"))


def by_keys(axis: DataFrame, picked: DataFrame) -> Selection:
    """Rows of ``picked(key, new_key)``, in the order of the new keys; repeats allowed."""
    return _gather(axis, axis.join(picked, "key"))


def by_mask(lm: LabeledMatrix, axis: str, mask: DataFrame) -> Selection:
    """Rows whose ``keep`` is true in ``mask(pos, keep)`` or ``mask(key, keep)``."""
    table = lm.axis(axis)
    n, given = table.count(), mask.count()
    if n != given:
        raise IndexError(f"boolean mask of length {given} does not match {axis} axis of length {n}")
    on = "key" if "key" in mask.columns else "pos"
    source = table if on == "key" else lm.positions(axis)
    kept = mask.where("keep").select(F.col(on).cast("bigint").alias(on))
    return Selection(source.join(kept, on, "left_semi").select(*table.columns))


def _single(axis: DataFrame, name: str) -> int:
    rows = axis.where(F.col("name") == name).select("key").limit(2).collect()
    if not rows:
        raise KeyError(f"name {name!r} not found")
    if len(rows) > 1:
        raise ValueError(f"name {name!r} repeats on this axis")
    return rows[0].key


def by_slice(lm: LabeledMatrix, axis: str, index: slice) -> Selection:
    """Positional slice, or label slice (stop included) if its bounds are text."""
    table = lm.axis(axis)
    placed = lm.positions(axis)
    start, stop = index.start, index.stop
    if isinstance(start, str) or isinstance(stop, str):
        bounds = {}
        for b in {b for b in (start, stop) if b is not None}:
            key = _single(table, b)
            bounds[b] = placed.where(F.col("key") == key).select("pos").first()[0]
        start = bounds.get(start)
        stop = None if stop is None else bounds[stop] + 1
    step = index.step or 1
    plain = (start is None or start >= 0) and (stop is None or stop >= 0) and step > 0
    if plain:  # needs no count of the axis
        cond = F.col("pos") >= (start or 0)
        if stop is not None:
            cond &= F.col("pos") < stop
        if step > 1:
            cond &= F.pmod(F.col("pos") - (start or 0), F.lit(step)) == 0
        return Selection(placed.where(cond).select(*table.columns))
    lo, hi, step = slice(start, stop, step).indices(table.count())
    inside = F.col("pos").between(lo, hi - 1) if step > 0 else F.col("pos").between(hi + 1, lo)
    kept = placed.where(inside & (F.pmod(F.col("pos") - lo, F.lit(abs(step))) == 0))
    if step < 0:
        kept = kept.withColumn("ord", -F.col("ord"))
    return Selection(kept.select(*table.columns))


def resolve(lm: LabeledMatrix, axis: str, index) -> Selection | None:
    """Turn any accepted index into a selection; ``None`` means the whole axis."""
    table = lm.axis(axis)
    if index is None or (isinstance(index, slice) and index == slice(None)):
        return None
    if isinstance(index, Selection):
        return index
    if isinstance(index, Column):
        return Selection(table.where(index))
    if isinstance(index, str):
        return Selection(table.where(F.col("key") == _single(table, index)))
    if isinstance(index, slice):
        return by_slice(lm, axis, index)
    if isinstance(index, DataFrame):
        if "keep" in index.columns:
            return by_mask(lm, axis, index)
        if "new_key" not in index.columns:
            if index.columns != ["key"]:
                raise ValueError("a selection table needs key, (name|pos, new_key) or (key|pos, keep)")
            return Selection(table.join(index, "key", "left_semi"))
        if "name" in index.columns:
            return by_labels(table, index)
        n = table.count()
        return by_positions(lm.positions(axis, n), index, n)
    if hasattr(index, "tolist"):
        index = index.tolist()
    if isinstance(index, int) and not isinstance(index, bool):
        n = table.count()
        if not -n <= index < n:
            raise IndexError(f"position {index} is out of range for size {n}")
        return Selection(lm.positions(axis, n).where(F.col("pos") == index % n).select(*table.columns))
    items = [x[0] if isinstance(x, (list, tuple)) and len(x) == 1 else x for x in index]
    if len(items) == 1 and isinstance(items[0], (list, tuple)):
        items = list(items[0])  # a (1, n) mask
    spark = lm.spark
    if items and all(isinstance(x, str) for x in items):
        return by_labels(table, small_table(spark, list(zip(items, range(len(items)))), "name string, new_key bigint"))
    if items and all(isinstance(x, bool) for x in items):
        return by_mask(lm, axis, small_table(spark, list(enumerate(items)), "pos bigint, keep boolean"))
    listed = small_table(spark, [(int(x), i) for i, x in enumerate(items)], "pos bigint, new_key bigint")
    n = table.count()
    return by_positions(lm.positions(axis, n), listed, n)


# -- carrying a selection to every element -----------------------------------------


def follow(df: DataFrame, col: str, sel: Selection) -> DataFrame:
    """Rows of ``df`` whose ``col`` survives, with the new key if keys change."""
    if sel.remap is None:
        return df.join(sel.keys.withColumnRenamed("key", col), col, "left_semi")
    pair = sel.remap.withColumnRenamed("key", col)
    cols = [F.col("new_key").alias(col) if c == col else F.col(c) for c in df.columns]
    return df.join(pair, col).select(*cols)


def _element(el, sel: Selection):
    if isinstance(el, Vectors):
        return Vectors(follow(el.rows, "key", sel), el.width, el.absent)
    if isinstance(el, SparseVectors):
        return SparseVectors(follow(el.rows, "key", sel), el.width)
    if isinstance(el, Table):
        return Table(follow(el.rows, "key", sel))
    return Graph(follow(follow(el.edges, "i_key", sel), "j_key", sel))


def _matrix(m: Matrix | None, axis: str, sel: Selection) -> Matrix | None:
    return None if m is None else Matrix(follow(m.cells, f"{axis}_key", sel), m.absent)


def apply(lm: LabeledMatrix, axis: str, sel: Selection | None) -> LabeledMatrix:
    """Carry one axis selection to every aligned element."""
    if sel is None:
        return lm
    changes = {
        axis: sel.table,
        f"{axis}_dense": sel.dense,
        "X": _matrix(lm.X, axis, sel),
        "layers": {k: _matrix(m, axis, sel) for k, m in lm.layers.items()},
        f"{axis}m": {k: _element(el, sel) for k, el in getattr(lm, f"{axis}m").items()},
        f"{axis}p": {k: _element(el, sel) for k, el in getattr(lm, f"{axis}p").items()},
    }
    cats = getattr(lm, f"{axis}_categories")
    if cats:
        changes[f"{axis}_categories"] = {c: prune(d, sel.table, c) for c, d in cats.items()}
    if axis == "obs" and lm.raw is not None:  # raw keeps its own variables
        changes["raw"] = Raw(_matrix(lm.raw.X, "obs", sel), lm.raw.var, lm.raw.varm, lm.raw.var_dense)
    return lm.replace(**changes)


def subset(lm: LabeledMatrix, obs=None, var=None) -> LabeledMatrix:
    """Select observations and variables; see ``resolve`` for accepted indices."""
    sel_obs, sel_var = resolve(lm, "obs", obs), resolve(lm, "var", var)
    return apply(apply(lm, "obs", sel_obs), "var", sel_var)


def drop(lm: LabeledMatrix, obs=None, var=None) -> LabeledMatrix:
    """Remove the selected observations or variables."""
    for axis, index in (("obs", obs), ("var", var)):
        sel = resolve(lm, axis, index)
        if sel is not None:
            gone = (sel.remap or sel.table).select("key")
            lm = apply(lm, axis, Selection(lm.axis(axis).join(gone, "key", "left_anti")))
    return lm


def subset_by_value(lm: LabeledMatrix, axis: str, name: str, cond: Callable[[Column], Column], layer=None) -> LabeledMatrix:
    """Keep rows of ``axis`` whose value for ``name`` on the other axis satisfies ``cond``.

    Rows without a stored cell are tested with the matrix's absent value.
    """
    from .access import matrix_vector

    vec = matrix_vector(lm, axis, name, layer=layer)
    return apply(lm, axis, Selection(lm.axis(axis).join(vec.where(cond(F.col("value"))), "key", "left_semi")))


class _Pieces:
    """Elements written once, partitioned by the piece that each row belongs to."""

    def __init__(self, lm: LabeledMatrix, column: str, axis: str):
        table = lm.axis(axis)
        self.codes = numbered(table.select(F.col(column).alias("value")).distinct(), "value", out="_piece")
        named = self.codes.withColumnRenamed("value", "_value")
        held = table.join(named, F.col(column).eqNullSafe(F.col("_value")))
        self.member = stored(held.select("key", "_piece"), "pieces")

    def lay(self, df: DataFrame, *cols: str) -> Callable[[int], DataFrame]:
        """Write rows of ``df`` whose ``cols`` all lie in one piece; gives the reader of a piece."""
        laid = df
        for c in cols:
            laid = laid.join(self.member.withColumnRenamed("key", c), [c, *(["_piece"] if "_piece" in laid.columns else [])])
        path = new_path(df.sparkSession, "pieces")
        # a piece with most rows is written by many tasks
        laid.hint("rebalance", F.col("_piece")).write.partitionBy("_piece").parquet(path)
        back = df.sparkSession.read.schema(laid.schema).parquet(path)
        return lambda code: back.where(F.col("_piece") == code).select(*[F.col(f"`{c}`") for c in df.columns])

    def element(self, el):
        if isinstance(el, Graph):
            read = self.lay(el.edges, "i_key", "j_key")
            return lambda code: Graph(read(code))
        read = self.lay(el.rows, "key")
        if isinstance(el, SparseVectors):
            return lambda code: SparseVectors(read(code), el.width)
        return lambda code: Vectors(read(code), el.width, el.absent) if isinstance(el, Vectors) else Table(read(code))

    def matrix(self, m: Matrix | None, axis: str):
        if m is None:
            return lambda code: None
        read = self.lay(m.cells, f"{axis}_key")
        return lambda code: Matrix(read(code), m.absent)


def split_by(lm: LabeledMatrix, column: str, axis: str = "obs") -> Iterator[tuple]:
    """One subset per value of an annotation column, in the order of the values.

    Each element is read once and written partitioned by value, however many
    values there are; a subset reads its own partitions only.
    """
    pieces = _Pieces(lm, column, axis)
    table = pieces.lay(lm.axis(axis), "key")
    X, layers = pieces.matrix(lm.X, axis), {k: pieces.matrix(m, axis) for k, m in lm.layers.items()}
    vectors = {k: pieces.element(el) for k, el in getattr(lm, f"{axis}m").items()}
    graphs = {k: pieces.element(el) for k, el in getattr(lm, f"{axis}p").items()}
    raw = pieces.matrix(lm.raw.X, "obs") if axis == "obs" and lm.raw is not None else None
    cats = getattr(lm, f"{axis}_categories")
    for value, code in pieces.codes.select("value", "_piece").orderBy("_piece").toLocalIterator():
        mine = table(code)
        changes = {
            axis: mine, f"{axis}_dense": False, "X": X(code), "layers": {k: read(code) for k, read in layers.items()},
            f"{axis}m": {k: read(code) for k, read in vectors.items()}, f"{axis}p": {k: read(code) for k, read in graphs.items()},
        }
        if cats:
            changes[f"{axis}_categories"] = {c: prune(d, mine, c) for c, d in cats.items()}
        if raw is not None:
            changes["raw"] = Raw(raw(code), lm.raw.var, lm.raw.varm, lm.raw.var_dense)
        yield value, lm.replace(**changes)


# -- raw ---------------------------------------------------------------------------


def raw_matrix(lm: LabeledMatrix) -> LabeledMatrix:
    """The raw part as a full object with the parent's observations and metadata."""
    if lm.raw is None:
        raise ValueError("this labeled matrix has no raw")
    r = lm.raw
    return LabeledMatrix(
        lm.obs, r.var, r.X, obsm=lm.obsm, varm=r.varm, uns=lm.uns, uns_tables=lm.uns_tables,
        obs_categories=lm.obs_categories, obs_dense=lm.obs_dense, var_dense=r.var_dense,
    )


def subset_raw(lm: LabeledMatrix, obs=None, var=None) -> Raw:
    """Slice raw; labels resolve against raw's own variable names."""
    sub = subset(raw_matrix(lm), obs, var)
    return Raw(sub.X, sub.var, sub.varm, sub.var_dense)


# -- categories under selection ----------------------------------------------------


def prune(cats: Categories, table: DataFrame, column: str) -> Categories:
    """Drop categories without remaining rows and renumber; colours follow.

    A palette whose length differs from the number of categories is dropped.
    """
    used = table.select(F.col(column).cast("string").alias("category")).distinct()
    kept = cats.table.join(used, "category", "left_semi")
    # with a known size this only extends the plan; no job runs per selection
    new = ranked(kept, "code", "new_code", n_rows=cats.size).withColumn("new_code", F.col("new_code").cast("int"))
    renumbered = new.select(F.col("new_code").alias("code"), "category")
    colors = cats.colors
    if colors is not None:
        if colors.count() != cats.table.count():
            colors = None
        else:
            colors = colors.join(new, "code").select(F.col("new_code").alias("code"), "color")
    return Categories(renumbered, cats.ordered, colors, cats.size)
