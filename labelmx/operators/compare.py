"""Are the copies of an element equal? Typed comparison of co-partitioned copies.

Copies meet by joins on the axis name or key, so each is exchanged once, and
every comparison ends in a ``bool_and``: partial verdicts are merged before they
move, nothing is written as text, and one row per comparison reaches the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Graph, SparseVectors, Table, Vectors

_WHOLE = (T.IntegralType, T.BooleanType)
_REAL = (T.FloatType, T.DoubleType)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def _whole_and_real(whole: Column, real: Column) -> Column:
    """A 64-bit integer and a double of the same value; neither is rounded to the other."""
    x = real.cast("double")
    fits = (x >= F.lit(-float(2**63))) & (x < F.lit(float(2**63))) & (x == F.floor(x).cast("double"))
    return F.when(fits, x.cast("bigint") == whole.cast("bigint")).otherwise(F.isnull(x) & F.isnull(whole))


def equal_values(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType) -> Column:
    """True where both hold the same value or are both NULL, else false; NaN equals NaN.

    Numbers compare by value whatever their types, integers exactly; -0.0 is 0.
    Values of kinds that do not compare differ.
    """
    if isinstance(a_kind, _WHOLE) and isinstance(b_kind, _WHOLE):
        return a.cast("bigint").eqNullSafe(b.cast("bigint"))
    if isinstance(a_kind, _REAL) and isinstance(b_kind, _REAL):
        return a.cast("double").eqNullSafe(b.cast("double"))
    if isinstance(a_kind, _WHOLE) and isinstance(b_kind, _REAL):
        return F.coalesce(_whole_and_real(a, b), F.lit(False))
    if isinstance(a_kind, _REAL) and isinstance(b_kind, _WHOLE):
        return F.coalesce(_whole_and_real(b, a), F.lit(False))
    if isinstance(a_kind, T.DecimalType) and isinstance(b_kind, T.DecimalType):
        return a.eqNullSafe(b)
    if isinstance(a_kind, T.ArrayType) and isinstance(b_kind, T.ArrayType) and a_kind.elementType != b_kind.elementType:
        same = F.forall(
            F.zip_with(a, b, lambda x, y: equal_values(x, a_kind.elementType, y, b_kind.elementType)), lambda ok: ok
        )
        return F.coalesce((F.size(a) == F.size(b)) & same, F.isnull(a) & F.isnull(b))
    if a_kind.simpleString() != b_kind.simpleString():
        return F.lit(False)
    if _has_map(a_kind):  # maps have no order of their own
        return F.to_json(F.struct(a.alias("v"))).eqNullSafe(F.to_json(F.struct(b.alias("v"))))
    return a.eqNullSafe(b)


def joined_columns(tables: Sequence[tuple[int, DataFrame]], target: DataFrame, held: Mapping[str, Sequence[int]]) -> DataFrame:
    """``target`` with column ``_<ds>_<i>`` for the ``i``-th element's copy in input ``ds``, NULL where a name is missing.

    Left joins keep the target's partitioning by name, so each input is
    exchanged once, however many there are.
    """
    out = target
    for ds, t in tables:
        mine = [F.col(f"`{c}`").alias(f"_{ds}_{i}") for i, (c, at) in enumerate(held.items()) if ds in at]
        if mine:
            out = out.join(t.select("name", *mine), "name", "left")
    return out


def differing_columns(tables: Sequence[tuple[int, DataFrame]], target: DataFrame, cols: Sequence[str]) -> set[str]:
    """Annotation columns whose copies differ after alignment to ``target(name)``.

    A missing name, a NULL or a NaN in any copy makes the column differ; without
    names nothing does.
    """
    held = {c: [ds for ds, t in tables if c in t.columns] for c in cols}
    kinds = {(ds, c): t.schema[c].dataType for ds, t in tables for c in cols if c in t.columns}
    verdicts = []
    for i, (c, at) in enumerate(held.items()):
        lead, kind = F.col(f"_{at[0]}_{i}"), kinds[at[0], c]
        known = F.isnotnull(lead) & ~F.isnan(lead) if isinstance(kind, _REAL) else F.isnotnull(lead)
        same = [equal_values(lead, kind, F.col(f"_{ds}_{i}"), kinds[ds, c]) for ds in at[1:]]
        verdicts.append(F.bool_and(reduce(Column.__and__, same, known)).alias(f"_{i}"))
    if not verdicts:
        return set()
    row = joined_columns(tables, target.select("name"), held).agg(*verdicts).first()
    return {c for c, ok in zip(held, row) if ok is False}


def _with_value(el) -> tuple[DataFrame, list[str], list[str]]:
    """Rows of an element, its key columns and its value columns."""
    if isinstance(el, Graph):
        return el.edges.where("value <> 0 OR value IS NULL"), ["i_key", "j_key"], ["value"]  # a zero equals an absent edge
    if isinstance(el, SparseVectors):
        return el.rows.where("value <> 0 OR value IS NULL"), ["key", "index"], ["value"]
    return el.rows, ["key"], ["vec"] if isinstance(el, Vectors) else el.columns


def _comparable(els: Sequence[Vectors | Table | Graph]) -> bool:
    """Copies of one kind and shape; others differ without a look at their rows."""
    if len({type(e) for e in els}) > 1:
        return False
    if isinstance(els[0], SparseVectors):
        return len({e.width for e in els}) == 1
    if isinstance(els[0], Vectors):
        return len({e.width for e in els}) == 1 and len({e.absent == 0 for e in els}) == 1
    if isinstance(els[0], Table):
        shape = lambda e: [(c, e.rows.schema[c].dataType.simpleString()) for c in e.columns]
        return all(shape(e) == shape(els[0]) for e in els)
    return True


def _pair_verdict(a, b) -> DataFrame:
    """One row ``ok``: do two copies hold the same rows? None means that neither has any."""
    (left, on, cols), (right, _, _) = _with_value(a), _with_value(b)
    kinds = [(left.schema[c].dataType, right.schema[c].dataType) for c in cols]
    left = left.select(*on, F.lit(True).alias("_l"), *[F.col(f"`{c}`").alias(f"_l{i}") for i, c in enumerate(cols)])
    right = right.select(*on, F.lit(True).alias("_r"), *[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(cols)])
    same = [equal_values(F.col(f"_l{i}"), x, F.col(f"_r{i}"), y) for i, (x, y) in enumerate(kinds)]
    both = F.isnotnull("_l") & F.isnotnull("_r")
    return left.join(right, on, "full").agg(F.bool_and(reduce(Column.__and__, same, both)).alias("ok"))


def differing_vectors(copies: Mapping[str, Sequence[Vectors | Table | Graph]]) -> set[str]:
    """Aligned vectors, tables or graphs whose copies differ; NaN equals NaN.

    Each copy meets the first one, whose exchange is reused; all verdicts come
    from one job.
    """
    odd = {k for k, els in copies.items() if not _comparable(els)}
    pairs = [
        _pair_verdict(els[0], other).select(F.lit(k).alias("element"), "ok")
        for k, els in copies.items() if k not in odd for other in els[1:]
    ]
    if pairs:
        odd |= {r.element for r in reduce(DataFrame.unionByName, pairs).where("ok = false").collect()}
    return odd
