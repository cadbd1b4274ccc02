"""Stacking labeled matrices along one axis while aligning the other.

Inputs are tagged with ``ds`` and unioned once per element; keys of the stacked
axis are shifted so they stay unique, and one join with ``(ds, key) → new key``
aligns the other axis. When all inputs share one axis table the join is skipped.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import fit
from ..functions.text import suffixed
from ..model import Categories, Graph, LabeledMatrix, Matrix, Raw, SparseVectors, Table, Vectors, annotation
from ..plans.blocks import key_blocks, spread
from ..plans.durable import stored
from ..plans.local import small_table
from ..plans.ranks import ranked
from . import nested
from .build import to_sparse_vectors
from .by_values import ByValues, merged_element
from .compare import differing_vectors
from .merge import all_keys, attach_columns, decide, merge_columns, merge_outer_suffix, shared_keys
from .reshape import sparsify, transpose
from .select import raw_matrix


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def same_value(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))


@dataclass(frozen=True)
class Shift:
    """Additions that keep keys and order of one input clear of the others."""

    key: int
    ord: int
    n: int


def key_shifts(tables: Sequence[DataFrame]) -> list[Shift]:
    """One small job over the axis tables: a row of bounds per input."""
    bounds = _union([
        t.agg(F.min("key").alias("k0"), F.max("key").alias("k1"), F.min("ord").alias("o0"), F.max("ord").alias("o1"), F.count(F.lit(1)).alias("n"))
        .withColumn("ds", F.lit(i)) for i, t in enumerate(tables)
    ]).collect()
    out, next_key, next_ord = [], 0, 0
    for b in sorted(bounds, key=lambda r: r.ds):
        if b.n == 0:
            out.append(Shift(0, 0, 0))
            continue
        out.append(Shift(next_key - b.k0, next_ord - b.o0, b.n))
        next_key += b.k1 - b.k0 + 1
        next_ord += b.o1 - b.o0 + 1
    return out


# -- the aligned axis --------------------------------------------------------------


@dataclass(frozen=True)
class Alignment:
    """``target(key, ord, name)`` and ``mapping(ds, old_key, new_key)``; no mapping if nothing changes."""

    target: DataFrame
    mapping: DataFrame | None
    dense: bool

    def apply(self, df: DataFrame, col: str) -> DataFrame:
        """Replace ``col`` of a ``ds``-tagged table by the merged key; unmatched rows go."""
        if self.mapping is None:
            return df
        pair = self.mapping.withColumnRenamed("old_key", col)
        cols = [F.col("new_key").alias(col) if c == col else F.col(c) for c in df.columns]
        return df.join(pair, ["ds", col]).select(*cols)

    def absent_from(self, ds: int) -> DataFrame:
        """Target rows that input ``ds`` lacks."""
        if self.mapping is None:
            return self.target.where(F.lit(False))
        held = self.mapping.where(F.col("ds") == ds).select(F.col("new_key").alias("key"))
        return self.target.join(held, "key", "left_anti")


def align(lms: Sequence[LabeledMatrix], axis: str, join: str) -> Alignment:
    """Merge the names of ``axis``.

    ``inner``: shared names in the order of the first input. ``outer``: all
    names, in the common order if all non-empty inputs agree, else sorted.
    """
    if join not in ("inner", "outer"):
        raise ValueError(f"join must be 'inner' or 'outer', not {join!r}")
    tables = [lm.axis(axis) for lm in lms]
    first = tables[0]
    if all(t is first or t.sameSemantics(first) for t in tables):
        return Alignment(first.select("key", "ord", "name"), None, lms[0].is_dense_axis(axis))
    # the names are read many times below and by every element: compute them once
    names = stored(_union([
        lm.positions(axis).select(F.lit(i).alias("ds"), F.col("key").alias("old_key"), "ord", "pos", "name")
        for i, lm in enumerate(lms)
    ]), "names")
    per_name = names.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct(F.col("old_key").alias("key"), "ord"), "ds").alias("f"),
        (F.min("pos") == F.max("pos")).alias("level"),
        F.count_distinct("ds").alias("n_ds"),
    )
    holders = sorted(r.ds for r in names.select("ds").distinct().collect())
    summary = per_name.agg(
        F.count_if(F.col("n") > F.col("n_ds")).alias("repeats"), F.count(F.lit(1)).alias("n_names"),
        F.min("n").alias("fewest"), F.bool_and("level").alias("level"),
    ).first()
    if summary.repeats:
        raise ValueError(f"{axis} names must be unique to be aligned: {summary.repeats} repeat")
    if join == "inner":
        target = per_name.where(F.col("n") == len(lms)).select("f.key", "f.ord", "name")
        dense = False
    elif not holders or (summary.level and summary.fewest == len(holders)):
        lead = holders[0] if holders else 0
        target = tables[lead].select("key", "ord", "name")
        dense = lms[lead].is_dense_axis(axis)
    else:
        target = ranked(per_name.select("name"), "name", "ord", n_rows=summary.n_names).select(F.col("ord").alias("key"), "ord", "name")
        dense = True
    target = stored(target, "target")
    mapping = names.join(target.select("name", F.col("key").alias("new_key")), "name").select("ds", "old_key", "new_key")
    return Alignment(target, mapping, dense)


def reindex(lm: LabeledMatrix, axis: str, names: DataFrame, *, fill_value: float | None = None) -> LabeledMatrix:
    """Realign X, layers and vectors of one axis to ``names(key, ord, name)``.

    Names the object lacks are filled; names it has beyond the target are lost.
    Target names must be unique. The object is returned unchanged if its names
    already are the target.
    """
    if names.sameSemantics(lm.axis(axis).select("key", "ord", "name")):
        return lm
    if not names.groupBy("name").count().where("count > 1").isEmpty():
        raise ValueError("target names must be unique")
    if axis == "obs":
        return transpose(reindex(transpose(lm), "var", names, fill_value=fill_value))
    mapping = lm.var.join(names.select("name", F.col("key").alias("new_key")), "name")
    to = Alignment(names, mapping.select(F.lit(0).alias("ds"), F.col("key").alias("old_key"), "new_key"), False)
    rows = lm.obs.select(F.lit(0).alias("ds"), F.col("key").alias("obs_key"))

    def move(m: Matrix) -> Matrix:
        cells = to.apply(m.cells.select(F.lit(0).alias("ds"), "obs_key", "var_key", "value"), "var_key")
        fill = m.absent if fill_value is None else fill_value
        return Matrix(_filled(cells, rows, [to.absent_from(0)], fill, m.absent), m.absent)

    return lm.replace(
        var=attach_columns([lm.var], names.select("key", "ord", "name"), [(0, c, c) for c in annotation(lm.var)]),
        X=None if lm.X is None else move(lm.X),
        layers={k: move(m) for k, m in lm.layers.items()},
        varm={k: _aligned(el, 0, to) for k, el in lm.varm.items()},
        varp={k: _aligned(el, 0, to) for k, el in lm.varp.items()},
        var_dense=False,
    )


# -- matrices ----------------------------------------------------------------------


def _shifted(parts: Sequence[tuple[int, DataFrame]], shifts: Sequence[Shift], *cols: str) -> DataFrame:
    """The parts of inputs, tagged with ``ds``, with their key columns shifted.

    The shifts come from a table. As literals they would give each part a filter of its own
    (not null after the addition), and parts made from one table could not share its exchanges.
    """
    tagged = _union([df.withColumn("ds", F.lit(i)) for i, df in parts])
    by = small_table(tagged.sparkSession, [(i, shifts[i].key) for i, _ in parts], "ds int, _shift bigint")
    moved = [(F.col(c) + F.col("_shift")).alias(c) if c in cols else F.col(c) for c in tagged.columns]
    return tagged.join(F.broadcast(by), "ds").select(*moved)


def _filled(cells: DataFrame, rows: DataFrame, gaps: Sequence[DataFrame], fill: float, absent: float) -> DataFrame:
    """Add the cells that alignment introduces, unless they equal the absent value.

    Stored-zero cells of the inputs stay absent even for another fill. ``gaps[i]``
    lists the target keys input ``i`` lacks.
    """
    plain = cells.select("obs_key", "var_key", "value")
    if same_value(fill, absent):
        return plain
    missing = _union([g.select(F.lit(i).alias("ds"), "key", "ord") for i, g in enumerate(gaps)])
    n_missing = missing.count()
    blocks = key_blocks(missing, ["ds"], n_keys=n_missing)
    grid = spread(rows.select("ds", "obs_key"), blocks, n_missing, ["ds"])
    kind = plain.schema["value"].dataType
    added = grid.select("obs_key", F.explode("keys").alias("var_key"), F.lit(float(fill)).cast(kind).alias("value"))
    return plain.unionByName(added)


def stack_matrices(
    inputs: Sequence[LabeledMatrix],
    matrices: Sequence[Matrix | None],
    shifts: Sequence[Shift],
    to: Alignment,
    fill_value: float | None,
) -> Matrix:
    """Stack one matrix per input; a missing one is a gap over all variables.

    The result is sparse if any input is: then a dense input gives up its zeros
    and shows its absent cells as NaN.
    """
    present = [m for m in matrices if m is not None]
    sparse = any(m.sparse for m in present)
    absent = 0.0 if sparse else math.nan
    fill = absent if fill_value is None else float(fill_value)
    parts = []
    for i, (lm, m) in enumerate(zip(inputs, matrices)):
        if m is None:
            continue
        cells = (sparsify(m, lm) if sparse and not m.sparse else m).cells
        parts.append((i, cells.select("obs_key", "var_key", "value")))
    cells = to.apply(_shifted(parts, shifts, "obs_key"), "var_key")
    rows = stacked_rows(inputs, shifts)
    if same_value(fill, absent):
        return Matrix(cells.select("obs_key", "var_key", "value"), absent)
    gaps = [to.target if m is None else to.absent_from(i) for i, m in enumerate(matrices)]
    return Matrix(_filled(cells, rows, gaps, fill, absent), absent)


def stacked_rows(inputs: Sequence[LabeledMatrix], shifts: Sequence[Shift]) -> DataFrame:
    return _union([
        lm.obs.select(F.lit(i).alias("ds"), (F.col("key") + s.key).alias("obs_key"))
        for i, (lm, s) in enumerate(zip(inputs, shifts))
    ])


# -- annotation, vectors, graphs ---------------------------------------------------


def stack_annotation(tables: Sequence[DataFrame], shifts: Sequence[Shift], keys: Sequence[str], join: str, label: str | None = None, index_unique: str | None = None) -> DataFrame:
    """Annotation of the stacked axis: shared columns, or all with nulls."""
    cols = [annotation(t) for t in tables]
    keep = shared_keys(cols) if join == "inner" else all_keys(cols)
    parts = []
    for t, s, key in zip(tables, shifts, keys):
        name = F.col("name") if index_unique is None else suffixed(F.col("name"), index_unique, key)
        shown = t.select(
            (F.col("key") + s.key).alias("key"), (F.col("ord") + s.ord).alias("ord"), name.alias("name"),
            *[c for c in keep if c in t.columns],
        )
        parts.append(shown if label is None else shown.withColumn(label, F.lit(key)))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select("key", "ord", "name", *[c for c in keep if c != label], *([label] if label else []))


def _stack_sparse(inputs: Sequence[LabeledMatrix], els: Sequence, shifts: Sequence[Shift], width: int, fill_value: float | None) -> SparseVectors:
    """Entries of sparse and dense vectors side by side, cut to ``width``.

    Without a fill value other than 0 nothing is added for what an input lacks; with
    one, its rows get an entry at each place beyond the input's own width.
    """
    parts = []
    for lm, e, s in zip(inputs, els, shifts):
        own = 0 if e is None else min(e.width, width)
        if e is not None:
            rows = (e if isinstance(e, SparseVectors) else to_sparse_vectors(e)).rows
            parts.append(rows.where(F.col("index") < own).select((F.col("key") + s.key).alias("key"), F.col("index").cast("bigint"), F.col("value").cast("double").alias("value")))
        if fill_value and own < width:
            lacking = F.explode(F.sequence(F.lit(own).cast("bigint"), F.lit(width - 1).cast("bigint")))
            parts.append(lm.obs.select((F.col("key") + s.key).alias("key"), lacking.alias("index"), F.lit(float(fill_value)).alias("value")))
    return SparseVectors(_union(parts), width)


def stack_vectors(inputs: Sequence[LabeledMatrix], shifts: Sequence[Shift], join: str, fill_value: float | None) -> dict:
    """Vectors and tables of the stacked axis.

    Inner keeps shared elements at the smallest width, outer all elements padded
    to the largest. Sparse vectors anywhere make the element sparse. An input without a table contributes rows of nulls.
    """
    maps = [lm.obsm for lm in inputs]
    out = {}
    for k in shared_keys(maps) if join == "inner" else all_keys(maps):
        els = [m.get(k) for m in maps]
        held = [e for e in els if e is not None]
        moved = lambda df, s: df.withColumn("key", F.col("key") + s.key)
        if any(isinstance(e, Table) for e in held):
            if not all(isinstance(e, Table) for e in held):
                raise NotImplementedError(f"obsm[{k!r}] is a table in some inputs and vectors in others")
            cols = shared_keys([e.columns for e in held]) if join == "inner" else all_keys([e.columns for e in held])
            parts = [
                moved((lm.obs.select("key") if e is None else e.rows.select("key", *[c for c in cols if c in e.columns])), s)
                for lm, e, s in zip(inputs, els, shifts)
            ]
            rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            out[k] = Table(rows.select("key", *cols))
            continue
        if any(isinstance(e, SparseVectors) for e in held):
            out[k] = _stack_sparse(inputs, els, shifts, (min if join == "inner" else max)(e.width for e in held), fill_value)
            continue
        width = (min if join == "inner" else max)(e.width for e in held)
        absent = 0.0 if any(e.absent == 0 for e in held) else math.nan
        fill = absent if fill_value is None else float(fill_value)
        parts = []
        for lm, e, s in zip(inputs, els, shifts):
            if e is None:
                rows = lm.obs.select("key", F.array_repeat(F.lit(fill), width).alias("vec"))
            else:
                rows = e.rows.select("key", fit(F.col("vec"), width, fill).alias("vec"))
            parts.append(moved(rows, s))
        out[k] = Vectors(_union(parts), width, absent)
    return out


def block_diagonal(inputs: Sequence[LabeledMatrix], shifts: Sequence[Shift], join: str) -> dict:
    """Graphs of the stacked axis side by side; an absent graph is an empty block."""
    maps = [lm.obsp for lm in inputs]
    out = {}
    for k in shared_keys(maps) if join == "inner" else all_keys(maps):
        parts = [(i, m[k].edges.select("i_key", "j_key", "value")) for i, m in enumerate(maps) if k in m]
        out[k] = Graph(_shifted(parts, shifts, "i_key", "j_key").drop("ds"))
    return out


def _aligned(el, ds: int, to: Alignment):
    """An element of the aligned axis on the merged keys, missing names filled by default."""
    tag = lambda df: df.withColumn("ds", F.lit(ds))
    if isinstance(el, Graph):
        return Graph(to.apply(to.apply(tag(el.edges), "i_key"), "j_key").drop("ds"))
    if isinstance(el, SparseVectors):
        return SparseVectors(to.apply(tag(el.rows), "key").drop("ds"), el.width)
    rows = to.target.select("key").join(to.apply(tag(el.rows), "key").drop("ds"), "key", "left")
    if isinstance(el, Table):
        return Table(rows.select("key", *el.columns))
    empty = F.array_repeat(F.lit(el.absent), el.width)
    return Vectors(rows.select("key", F.coalesce("vec", empty).alias("vec")), el.width, el.absent)


def merge_aligned(maps: Sequence[Mapping], to: Alignment, strategy) -> dict:
    """Vectors or graphs of the aligned axis, kept as a whole by the strategy."""
    present = {k: [i for i, m in enumerate(maps) if k in m] for k in all_keys(maps)}
    moved = lambda k, i: _aligned(maps[i][k], i, to)
    if isinstance(strategy, ByValues):
        merged = {k: merged_element(strategy, k, [moved(k, i) for i in at]) for k, at in present.items()}
        return {k: el for k, el in merged.items() if el is not None}
    chosen = decide(
        strategy, present, len(maps),
        lambda ks: differing_vectors({k: [moved(k, i) for i in present[k]] for k in ks}),
    )
    return {k: moved(k, i) for k, i in chosen.items()}


def merge_uns(inputs: Sequence[LabeledMatrix], strategy) -> tuple[DataFrame | None, dict]:
    """Nested metadata of all inputs merged path by path, and the tables among it."""
    held = [(i, lm.uns) for i, lm in enumerate(inputs) if lm.uns is not None]
    tables = [(i, lm.uns_tables) for i, lm in enumerate(inputs) if lm.uns_tables]
    if strategy is None or not (held or tables):
        return None, {}
    parts = [u.select(F.lit(i).alias("ds"), "path", "value") for i, u in held]
    if tables:
        parts.append(nested.placeholders(inputs[0].spark, tables, differing_vectors))
    tagged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    merged = strategy(tagged, len(inputs)) if callable(strategy) else nested.merge(tagged, len(inputs), strategy)
    return nested.chosen_tables(merged.select("path", "value"), tables) if tables else (merged, {})


def _shared_dictionaries(inputs: Sequence[LabeledMatrix], columns: Sequence[str]) -> dict[str, Categories]:
    """Dictionaries that all inputs share stay; others become plain text."""
    out = {}
    for c in columns:
        held = [lm.obs_categories.get(c) for lm in inputs]
        if all(h is not None for h in held) and all(
            h is held[0] or (h.table.sameSemantics(held[0].table) and h.ordered == held[0].ordered) for h in held
        ):
            out[c] = held[0]
    return out


def _stacked_raw(lms: Sequence[LabeledMatrix], axis: str, options: Mapping) -> Raw | None:
    """Raw of all inputs stacked like the matrices above it; None, with a warning, if an input lacks it."""
    without = [i for i, lm in enumerate(lms) if lm.raw is None]
    if not without:
        plain = lambda lm: raw_matrix(lm).replace(obs=lm.obs.select("key", "ord", "name"), obsm={}, uns=None, uns_tables={}, obs_categories={})
        below = concat([plain(lm) for lm in lms], axis=axis, **options)
        return Raw(below.X, below.var, below.varm, below.var_dense)
    if len(without) < len(lms):
        warnings.warn(f"raw is left out, as inputs {without} have none", UserWarning, stacklevel=3)
    return None


# -- the whole operation -----------------------------------------------------------


def concat(
    lms: Sequence[LabeledMatrix] | Mapping[str, LabeledMatrix],
    *,
    axis: str = "obs",
    join: str = "inner",
    merge=None,
    uns_merge=None,
    label: str | None = None,
    keys: Sequence[str] | None = None,
    index_unique: str | None = None,
    fill_value: float | None = None,
    pairwise: bool = False,
) -> LabeledMatrix:
    """Stack labeled matrices along ``axis`` and align the other one.

    ``merge`` / ``uns_merge`` are ``None``, ``same``, ``unique``, ``first``,
    ``only`` or a callable (see ``merge.decide`` and ``merge_uns``); ``merge`` may
    also be a ``ByValues``, which sees the values of the copies.
    """
    if isinstance(lms, Mapping):
        if keys is not None:
            raise TypeError("give source keys either as a mapping or as keys=, not both")
        keys, lms = list(lms), list(lms.values())
    lms = list(lms)
    if not lms:
        raise ValueError("nothing to concatenate")
    if axis not in ("obs", "var"):
        raise ValueError(f"axis must be 'obs' or 'var', not {axis!r}")
    keys = [str(k) for k in keys] if keys is not None else [str(i) for i in range(len(lms))]
    options = dict(join=join, label=label, keys=keys, index_unique=index_unique, fill_value=fill_value)

    raw = _stacked_raw(lms, axis, options)
    if axis == "var":
        flipped = concat([transpose(lm) for lm in lms], axis="obs", merge=merge, uns_merge=uns_merge, pairwise=pairwise, **options)
        return transpose(flipped).replace(raw=raw)

    shifts = key_shifts([lm.obs for lm in lms])
    to = align(lms, "var", join)
    has_x = [lm.X is not None for lm in lms]
    if any(has_x) and not all(has_x):
        raise ValueError("some inputs have X and some do not")
    layer_maps = [lm.layers for lm in lms]
    layer_keys = shared_keys(layer_maps) if join == "inner" else all_keys(layer_maps)
    layer_fill = None if join == "inner" else fill_value

    obs = stack_annotation([lm.obs for lm in lms], shifts, keys, join, label, index_unique)
    dictionaries = _shared_dictionaries(lms, annotation(obs))
    if label is not None:
        codes = small_table(lms[0].spark, list(enumerate(keys)), "code int, category string")
        dictionaries[label] = Categories(codes, size=len(keys))
    uns, uns_tables = merge_uns(lms, uns_merge)
    return LabeledMatrix(
        obs=obs,
        var=merge_columns([lm.var for lm in lms], to.target, merge, [annotation(lm.var) for lm in lms]),
        X=stack_matrices(lms, [lm.X for lm in lms], shifts, to, fill_value) if all(has_x) else None,
        layers={k: stack_matrices(lms, [m.get(k) for m in layer_maps], shifts, to, layer_fill) for k in layer_keys},
        obsm=stack_vectors(lms, shifts, join, None if join == "inner" else fill_value),
        varm=merge_aligned([lm.varm for lm in lms], to, merge),
        obsp=block_diagonal(lms, shifts, join) if pairwise else {},
        varp=merge_aligned([lm.varp for lm in lms], to, merge),
        uns=uns, uns_tables=uns_tables,
        raw=raw,
        obs_categories=dictionaries,
        obs_dense=all(lm.obs_dense for lm in lms),
        var_dense=to.dense,
    )


def concatenate(
    first: LabeledMatrix,
    *others: LabeledMatrix,
    join: str = "inner",
    batch_key: str = "batch",
    batch_categories: Sequence[str] | None = None,
    uns_merge=None,
    index_unique: str | None = "-",
    fill_value: float | None = None,
) -> LabeledMatrix:
    """Method form of ``concat`` with older defaults.

    Observations get a ``batch`` column and suffixed names and keep all columns;
    variable vectors are dropped; variable columns equal in all inputs keep their
    name, others appear once per input as ``col-batch``, ordered by batch.
    """
    lms = [first, *others]
    keys = [str(k) for k in batch_categories] if batch_categories is not None else [str(i) for i in range(len(lms))]
    out = concat(
        lms, join=join, label=batch_key, keys=keys, uns_merge=uns_merge, index_unique=index_unique, fill_value=fill_value
    )
    obs = stack_annotation([lm.obs for lm in lms], key_shifts([lm.obs for lm in lms]), keys, "outer", batch_key, index_unique)
    target = out.var.select("key", "ord", "name")
    by_label = sorted(range(len(lms)), key=keys.__getitem__)
    var = merge_outer_suffix([lm.var for lm in lms], target, keys, [annotation(lm.var) for lm in lms], "same", inputs=by_label)
    return out.replace(obs=obs, var=var, varm={})
