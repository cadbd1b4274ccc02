"""The labeled matrix: lazy DataFrames that stay aligned.

Rows are observations (``obs``), columns are variables (``var``). An axis table
has ``key`` (unique BIGINT, the join key), ``ord`` (BIGINT, unique, gives the
order), ``name`` (STRING, may repeat) and annotation columns. Matrices are long
tables of cells, so nothing depends on one machine holding a row or a column.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.durable import stored
from .plans.ranks import ranked, sort_text

RESERVED = ("key", "ord", "name")
NAN = math.nan


@dataclass(frozen=True)
class Matrix:
    """Cells ``(obs_key, var_key, value)``, one row per stored cell.

    ``absent`` is what a cell without a row means: 0 for a sparse matrix, NaN
    for a dense one (which stores its zeros).
    """

    cells: DataFrame
    absent: float = 0.0

    @property
    def sparse(self) -> bool:
        return self.absent == 0.0

    def cast(self, dtype: str) -> "Matrix":
        return Matrix(self.cells.withColumn("value", F.col("value").cast(dtype)), self.absent)


@dataclass(frozen=True)
class Vectors:
    """One numeric vector per key of an axis: rows ``(key, vec ARRAY<DOUBLE>)``."""

    rows: DataFrame
    width: int
    absent: float = NAN


@dataclass(frozen=True)
class SparseVectors:
    """One numeric vector per key of an axis, entries only: rows ``(key, index, value)``.

    ``index`` is 0 … ``width``-1; an entry without a row is 0. No array is ever
    built, so ``width`` may be in the millions.
    """

    rows: DataFrame
    width: int


@dataclass(frozen=True)
class Table:
    """One typed row per key of an axis: ``(key, columns…)``."""

    rows: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "key"]


@dataclass(frozen=True)
class Graph:
    """Edges ``(i_key, j_key, value)`` between keys of one axis."""

    edges: DataFrame


@dataclass(frozen=True)
class Categories:
    """Dictionary ``(code, category)`` of a column, with a colour per category if set."""

    table: DataFrame
    ordered: bool = False
    colors: DataFrame | None = None  # (code, color)
    size: int | None = None  # at most this many categories, if known


@dataclass(frozen=True)
class Raw:
    """Frozen matrix, variables and variable vectors; observations are shared."""

    X: Matrix | None
    var: DataFrame
    varm: Mapping[str, Vectors | Table] = field(default_factory=dict)
    var_dense: bool = False


@dataclass(frozen=True)
class LabeledMatrix:
    """An immutable bundle of aligned elements; every operation returns a new one."""

    obs: DataFrame
    var: DataFrame
    X: Matrix | None = None
    layers: Mapping[str, Matrix] = field(default_factory=dict)
    obsm: Mapping[str, Vectors | SparseVectors | Table] = field(default_factory=dict)
    varm: Mapping[str, Vectors | SparseVectors | Table] = field(default_factory=dict)
    obsp: Mapping[str, Graph] = field(default_factory=dict)
    varp: Mapping[str, Graph] = field(default_factory=dict)
    uns: DataFrame | None = None  # (path ARRAY<STRING>, value STRING), see operators.nested
    uns_tables: Mapping[tuple[str, ...], Table | Graph] = field(default_factory=dict)  # metadata that is a table or a sparse matrix, by path
    raw: Raw | None = None
    obs_categories: Mapping[str, Categories] = field(default_factory=dict)
    var_categories: Mapping[str, Categories] = field(default_factory=dict)
    obs_dense: bool = False  # ``ord`` is already 0 … n-1
    var_dense: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.obs.sparkSession

    def replace(self, **changes) -> "LabeledMatrix":
        return dataclasses.replace(self, **changes)

    def axis(self, axis: str) -> DataFrame:
        return {"obs": self.obs, "var": self.var}[axis]

    def is_dense_axis(self, axis: str) -> bool:
        return self.obs_dense if axis == "obs" else self.var_dense

    def positions(self, axis: str, n: int | None = None) -> DataFrame:
        """Axis table with ``pos`` = 0 … n-1; free when the order is dense.

        Pass ``n`` if the axis has been counted already.
        """
        table = self.axis(axis)
        if self.is_dense_axis(axis):
            return table.withColumn("pos", F.col("ord"))
        return ranked(table, "ord", "pos", n_rows=n)

    @property
    def shape(self) -> tuple[int, int]:
        """``(n_obs, n_vars)``; counts both axis tables."""
        return self.obs.count(), self.var.count()

    # The operators below live in their own modules; these are their method forms.

    def subset(self, obs=None, var=None, **kw) -> "LabeledMatrix":
        from .operators.select import subset
        return subset(self, obs, var, **kw)

    def __getitem__(self, index) -> "LabeledMatrix":
        obs, var = index if isinstance(index, tuple) else (index, None)
        return self.subset(obs, var)

    def transpose(self) -> "LabeledMatrix":
        from .operators.reshape import transpose
        return transpose(self)

    T = property(transpose)

    def obs_vector(self, key: str, *, layer: str | None = None) -> DataFrame:
        from .operators.access import vector
        return vector(self, "obs", key, layer=layer)

    def var_vector(self, key: str, *, layer: str | None = None) -> DataFrame:
        from .operators.access import vector
        return vector(self, "var", key, layer=layer)

    def to_wide(self, layer: str | None = None, **kw) -> DataFrame:
        from .operators.access import to_wide
        return to_wide(self, layer, **kw)

    def write(self, path: str, **kw):
        from .sources.bundle import write_bundle
        return write_bundle(self, path, **kw)


def axis_table(
    df: DataFrame,
    *,
    key: str | None = None,
    name: str | None = None,
    order: str | Sequence[str] | None = None,
) -> DataFrame:
    """Normalise a table to ``(key, ord, name, annotation…)``.

    ``key`` names a unique integer column. Without one, rows are numbered along
    ``order`` (one column, or several non-negative integer columns) and the table
    is stored, as every element of the matrix will be joined to those numbers.
    ``name`` defaults to the key; other columns, ``key``'s source excepted, are
    kept as annotation.
    """
    if key is None and order is None:
        raise ValueError("give key= or order= to identify the rows of an axis")
    order = [order] if isinstance(order, str) else list(order or [])
    drop = {c for c in (key, name) if c}
    keep = [c for c in df.columns if c not in drop and c not in RESERVED]
    if order:
        single = len(order) == 1
        by = order[0] if single else "_order"
        numbered = df if single else df.withColumn("_order", sort_text(*[F.col(c) for c in order]))
        numbered = ranked(numbered, by, "_ord")
    else:
        numbered = df.withColumn("_ord", F.col(key).cast("bigint"))
    ident = F.col(key).cast("bigint") if key else F.col("_ord")
    label = (F.col(name) if name else ident).cast("string")
    table = numbered.select(ident.alias("key"), F.col("_ord").alias("ord"), label.alias("name"), *keep)
    return table if key else stored(table, "axis")


def annotation(table: DataFrame) -> list[str]:
    """Annotation columns of an axis table."""
    return [c for c in table.columns if c not in RESERVED]


def is_text(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.StringType)
