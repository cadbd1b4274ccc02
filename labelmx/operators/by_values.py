"""Merge strategies that look at the values of aligned copies.

A ``ByValues`` rule is called inside the tasks, on Arrow arrays of one block of
keys: entry ``i`` of every array belongs to the same name, key or edge, and NULL
stands where a copy lacks it. The blocks are the batches of a join by name or
key, so no copy is collected and a hot name is one row. A rule must not depend
on where blocks begin and end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Graph, SparseVectors, Table, Vectors
from ..plans.durable import stored
from .compare import joined_columns

Copies = list[pa.Array]


@dataclass(frozen=True)
class ByValues:
    """A strategy of two functions of ``(element, copies)``; copies are in input order.

    ``keep`` judges a block; an element stays if all its blocks do, and all stay
    without it. ``value`` gives a block's merged values, as many as the block has
    rows, in the type of the first copy; without it the first copy is taken.
    Annotation columns come as arrays of their type, vectors as list arrays,
    tables as struct arrays, and graphs as the values of all edges of any copy.
    """

    keep: Callable[[str, Copies], bool] | None = None
    value: Callable[[str, Copies], object] | None = None


def _shaped(values, kind: pa.DataType, n: int, element: str) -> pa.Array:
    out = values if isinstance(values, pa.Array) else values.combine_chunks() if isinstance(values, pa.ChunkedArray) else pa.array(values)
    if len(out) != n:
        raise ValueError(f"the strategy gave {len(out)} values for {n} rows of {element!r}")
    return out if out.type == kind else out.cast(kind)


def _kept(rule: ByValues, rows: DataFrame, places: Mapping[str, Sequence[str]]) -> set[str]:
    """Elements whose blocks all pass ``keep``; ``places`` lists the columns of an element's copies."""
    if rule.keep is None:
        return set(places)
    named, keep = list(places.items()), rule.keep

    def judge(batches):
        bad: set[int] = set()
        for b in batches:
            if b.num_rows:
                bad |= {i for i, (k, cols) in enumerate(named) if i not in bad and not keep(k, [b.column(c) for c in cols])}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(bad), pa.int32())], ["element"])

    failed = rows.select(*[c for cols in places.values() for c in cols]).mapInArrow(judge, "element int").distinct()
    bad = {r.element for r in failed.collect()}  # at most one row per element
    return {k for i, (k, _) in enumerate(named) if i not in bad}


def _valued(rule: ByValues, rows: DataFrame, fixed: Sequence[str], places: Mapping[str, Sequence[str]], out: Mapping[str, str]) -> DataFrame:
    """``fixed`` columns and, for each element, its merged values as column ``out[element]``."""
    if rule.value is None:
        return rows.select(*fixed, *[F.col(cols[0]).alias(out[k]) for k, cols in places.items()])
    value, named, width = rule.value, list(places.items()), len(fixed)
    kinds = [T.StructField(out[k], rows.schema[cols[0]].dataType) for k, cols in named]
    schema = T.StructType([*[rows.schema[c] for c in fixed], *kinds])

    def run(batches):
        for b in batches:
            made = [_shaped(value(k, [b.column(c) for c in cols]), b.schema.field(cols[0]).type, b.num_rows, k) for k, cols in named]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *made], names=schema.names)

    return rows.select(*fixed, *[c for cols in places.values() for c in cols]).mapInArrow(run, schema)


def _aligned_once(rule: ByValues, rows: DataFrame) -> DataFrame:
    """Aligned copies are written once if ``keep`` and the values both read them."""
    return rows if rule.keep is None else stored(rows, "copies")


def merged_columns(rule: ByValues, tables: Sequence[tuple[int, DataFrame]], target: DataFrame, present: Mapping[str, Sequence[int]]) -> DataFrame:
    """``target`` with the annotation columns that the rule keeps, valued by it."""
    if not present:
        return target
    held = dict(present)
    rows = _aligned_once(rule, joined_columns(tables, target, held))
    places = {c: [f"_{ds}_{i}" for ds in at] for i, (c, at) in enumerate(held.items())}
    kept = _kept(rule, rows, places)
    places = {c: cols for c, cols in places.items() if c in kept}
    return _valued(rule, rows, target.columns, places, {c: c for c in places})


def merged_element(rule: ByValues, name: str, els: Sequence[Vectors | Table | Graph]) -> Vectors | Table | Graph | None:
    """Vectors, a table or a graph merged by the rule, or None; copies of several kinds are not kept."""
    first = els[0]
    if len({type(e) for e in els}) > 1:
        return None
    if isinstance(first, SparseVectors) and len({e.width for e in els}) > 1:
        return None
    if isinstance(first, (Graph, SparseVectors)):
        on = ["i_key", "j_key"] if isinstance(first, Graph) else ["key", "index"]
        entries = lambda e: e.edges if isinstance(e, Graph) else e.rows
        parts = [entries(e).select(*on, F.col("value").alias(f"_{i}")) for i, e in enumerate(els)]
        rows = reduce(DataFrame.union, [p.select(*on) for p in parts]).distinct()
    else:
        on = ["key"]
        held = lambda e: F.col("vec") if isinstance(e, Vectors) else F.struct(*[F.col(f"`{c}`") for c in e.columns])
        parts = [e.rows.select("key", held(e).alias(f"_{i}")) for i, e in enumerate(els)]
        rows = parts.pop(0)
    for p in parts:
        rows = rows.join(p, on, "left")
    rows = _aligned_once(rule, rows)
    places = {name: [f"_{i}" for i in range(len(els))]}
    if not _kept(rule, rows, places):
        return None
    out = _valued(rule, rows, on, places, {name: "_out"})
    if isinstance(first, Graph):
        return Graph(out.where("_out IS NOT NULL").withColumnRenamed("_out", "value"))
    if isinstance(first, SparseVectors):
        return SparseVectors(out.where("_out IS NOT NULL").withColumnRenamed("_out", "value"), first.width)
    if isinstance(first, Vectors):
        return Vectors(out.withColumnRenamed("_out", "vec"), first.width, first.absent)
    return Table(out.select("key", "_out.*"))
