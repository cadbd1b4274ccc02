"""Building labeled matrices from tables, frames, triplets and structs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import inflate
from ..model import LabeledMatrix, Matrix, Raw, SparseVectors, Table, Vectors, axis_table
from ..plans.local import small_table
from ..plans.ranks import ranked
from .nested import split_tables
from .validate import check_keys


def as_matrix(value, obs: DataFrame, var: DataFrame, dtype: str | None, absent: float = 0.0) -> Matrix | None:
    """A matrix from cells keyed by ``obs_key``/``var_key`` or by names."""
    if value is None:
        return None
    if not isinstance(value, Matrix):
        value = Matrix(value, absent)
    cells = value.cells
    for axis, table in (("obs", obs), ("var", var)):
        if f"{axis}_name" in cells.columns and f"{axis}_key" not in cells.columns:
            # a name the axis lacks, or holds twice, fails when the cells are computed
            keyed = table.groupBy(F.col("name").alias(f"{axis}_name")).agg(F.min("key").alias("_key"), F.count(F.lit(1)).alias("_n"))
            wrong = F.raise_error(F.concat(F.lit(f"cells name {axis} "), F.coalesce(f"{axis}_name", F.lit("NULL")), F.lit(", which the axis does not hold exactly once")))
            cells = cells.join(keyed, f"{axis}_name", "left")
            cells = cells.withColumn(f"{axis}_key", F.when(F.col("_n") == 1, F.col("_key")).otherwise(wrong)).drop("_key", "_n")
    missing = {"obs_key", "var_key", "value"} - set(cells.columns)
    if missing:
        raise ValueError(f"a matrix is two-dimensional: cells lack {sorted(missing)}")
    cells = cells.select("obs_key", "var_key", "value")
    out = Matrix(cells, value.absent)
    return out.cast(dtype) if dtype else out


def create(
    X=None,
    obs: DataFrame | None = None,
    var: DataFrame | None = None,
    *,
    layers: Mapping | None = None,
    obsm: Mapping | None = None,
    varm: Mapping | None = None,
    obsp: Mapping | None = None,
    varp: Mapping | None = None,
    uns: DataFrame | Mapping | None = None,
    raw: Raw | None = None,
    shape: tuple[int, int] | None = None,
    dtype: str | None = "float",
    absent: float = 0.0,
    check: bool = True,
) -> LabeledMatrix:
    """Align a matrix with its annotation tables.

    Keys that an axis lacks raise ``ValueError`` with counts. That reads the elements'
    keys once, in one job; ``check=False`` leaves it out for cells that were made from the axes.

    ``obs`` and ``var`` are axis tables (see ``axis_table``). Cells are cast to
    ``dtype`` (``float`` unless given, ``None`` keeps theirs). With no matrix, a
    ``shape`` gives numbered axes. ``uns`` is a path table or a mapping, whose leaves
    may be a ``Table`` or a ``Graph``.
    """
    rest = (obs, var, layers, obsm, varm, obsp, varp, uns, raw)
    if isinstance(X, LabeledMatrix):
        if any(v is not None for v in rest) or shape is not None:
            raise ValueError("X is already a labeled matrix: give no other element")
        return X
    if shape is not None:
        if X is not None:
            raise ValueError("shape is only for a labeled matrix without X")
        from pyspark.sql import SparkSession
        spark = SparkSession.active()
        numbered = lambda n: axis_table(spark.range(n).toDF("key"), key="key")
        obs = obs if obs is not None else numbered(shape[0])
        var = var if var is not None else numbered(shape[1])
    if obs is None or var is None:
        raise ValueError("give obs and var axis tables, or a shape")
    uns_tables: dict = {}
    if isinstance(uns, Mapping):
        uns, uns_tables = split_tables(obs.sparkSession, uns)
    lm = LabeledMatrix(
        obs=obs,
        var=var,
        uns_tables=uns_tables,
        X=as_matrix(X, obs, var, dtype, absent),
        layers={k: as_matrix(v, obs, var, None) for k, v in (layers or {}).items()},
        obsm=dict(obsm or {}),
        varm=dict(varm or {}),
        obsp=dict(obsp or {}),
        varp=dict(varp or {}),
        uns=uns,
        raw=raw,
        obs_dense=shape is not None,
        var_dense=shape is not None,
    )
    if check:
        came = {("X", "X"): X, **{("layers", k): v for k, v in (layers or {}).items()}}
        check_keys(lm, {at: v.cells if isinstance(v, Matrix) else v for at, v in came.items() if v is not None})
    return lm


def _common_numeric(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = {df.schema[c].dataType.simpleString() for c in cols}
    if len(kinds) == 1:
        return kinds.pop()
    return "string" if any(isinstance(df.schema[c].dataType, T.StringType) for c in cols) else "double"


def homogenize(df: DataFrame, ident: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Long form ``(ident, var_name, value)`` of a frame, in one common type."""
    cols = list(cols) if cols is not None else [c for c in df.columns if c != ident]
    kind = _common_numeric(df, cols)
    if len({df.schema[c].dataType for c in cols}) > 1:
        warnings.warn(f"columns of several types are converted to {kind}", UserWarning, stacklevel=2)
    same = df.select(ident, *[F.col(c).cast(kind).alias(c) for c in cols])
    return same.unpivot([ident], cols, "var_name", "value")


def from_wide(
    df: DataFrame, *, name: str, order: str | None = None, sparse: bool = False, dtype: str | None = "float"
) -> LabeledMatrix:
    """A wide frame as matrix: ``name`` labels rows, other columns are variables."""
    cols = [c for c in df.columns if c not in (name, order)]
    spark = df.sparkSession
    kind = _common_numeric(df, cols)
    rows = ranked(df, order or name, "key")
    obs = rows.select("key", F.col("key").alias("ord"), F.col(name).cast("string").alias("name"))
    var = small_table(spark, [(i, i, c) for i, c in enumerate(cols)], "key bigint, ord bigint, name string")
    # one pass over the rows: unfold each row's values with their column number
    values = F.array(*[F.col(c).cast(kind) for c in cols])
    cells = rows.select(F.col("key").alias("obs_key"), F.posexplode(values).alias("var_key", "value"))
    cells = cells.withColumn("var_key", F.col("var_key").cast("bigint"))
    if sparse:
        # a missing value is not a zero: it stays, as NaN where the type has one
        if kind in ("float", "double"):
            cells = cells.withColumn("value", F.coalesce("value", F.lit(float("nan")).cast(kind)))
        cells = cells.where(F.col("value").isNull() | (F.col("value") != 0))
    m = Matrix(cells, 0.0 if sparse else float("nan"))
    return LabeledMatrix(obs, var, m.cast(dtype) if dtype else m, obs_dense=True, var_dense=True)


def from_annotation(df: DataFrame, *, order: str | Sequence[str], axis: str = "obs") -> DataFrame:
    """Axis table from annotation columns.

    The column ``obs_names``/``row_names`` (``var_names``/``col_names``) gives the
    names; without one the names are "0" … "n-1".
    """
    special = ("obs_names", "row_names") if axis == "obs" else ("var_names", "col_names")
    name = next((c for c in special if c in df.columns), None)
    return axis_table(df, name=name, order=order)


def from_compressed(
    data: DataFrame, indptr: DataFrame, shape: tuple[int, int], *, by_rows: bool = True, dtype: str | None = "float"
) -> LabeledMatrix:
    """A matrix from a compressed triplet.

    ``data`` holds ``(pos, index, value)``: the stored values and their minor
    index. ``indptr`` holds ``(major, start, end)``, end exclusive. Each range is
    unfolded into its positions, in bounded pieces, and values meet their major
    index on the position: a unique key, so a very long row is no hot one.
    """
    piece = 1 << 18
    ranges = indptr.where(F.col("end") > F.col("start")).select("major", F.col("start").cast("bigint"), F.col("end").cast("bigint"))
    pieces = ranges.select("major", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(piece))).alias("low"))
    places = pieces.select("major", F.explode(F.sequence(F.col("low"), F.least(F.col("low") + piece, F.col("end")) - 1)).alias("pos"))
    joined = data.withColumn("pos", F.col("pos").cast("bigint")).join(places, "pos")
    major, minor = ("obs_key", "var_key") if by_rows else ("var_key", "obs_key")
    cells = joined.select(
        F.col("major").cast("bigint").alias(major), F.col("index").cast("bigint").alias(minor), "value"
    )
    return create(None, shape=shape, dtype=None, check=False).replace(
        X=as_matrix(cells.select("obs_key", "var_key", "value"), None, None, dtype)
    )


def from_struct(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """The named fields of a struct column as columns; other types are rejected."""
    if not isinstance(df.schema[col].dataType, T.StructType):
        raise TypeError(f"column {col!r} is not a struct")
    return df.select(*keep, f"{col}.*")


def assemble_vectors(lm: LabeledMatrix, axis: str, key: str, cols: Sequence[str]) -> LabeledMatrix:
    """Move annotation columns into one vector element."""
    table = lm.axis(axis)
    rows = table.select("key", F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))
    slot = f"{axis}m"
    return lm.replace(
        **{axis: table.drop(*cols), slot: {**getattr(lm, slot), key: Vectors(rows, len(cols))}}
    )


def to_sparse_vectors(el: Vectors) -> SparseVectors:
    """Entries of dense vectors; zeros are left out, NaN stays."""
    entries = el.rows.select("key", F.posexplode("vec").alias("index", "value"))
    return SparseVectors(entries.where("value <> 0").select("key", F.col("index").cast("bigint"), "value"), el.width)


def to_vectors(el: SparseVectors, keys: DataFrame) -> Vectors:
    """Dense vectors of ``keys(key)``; an array per row, so for widths that a row can hold."""
    item = F.struct(F.col("index").cast("int").alias("off"), F.col("value").cast("double").alias("value"))
    packed = el.rows.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("packed"))
    rows = keys.select("key").join(packed, "key", "left")
    held = F.coalesce("packed", F.array().cast("array<struct<off:int,value:double>>"))
    return Vectors(rows.select("key", inflate(held, F.lit(el.width), 0.0).alias("vec")), el.width, 0.0)


def flatten_vectors(lm: LabeledMatrix, axis: str) -> DataFrame:
    """Axis names with every vector element as columns ``key1 … keyN``."""
    from ..functions.arrays import flatten_columns

    out = lm.axis(axis).select("key", "name")
    for k, el in getattr(lm, f"{axis}m").items():
        if isinstance(el, SparseVectors):
            el = to_vectors(el, out)
        if isinstance(el, Vectors):
            part = el.rows.select("key", *flatten_columns(k, F.col("vec"), el.width))
        else:
            part = el.rows.select("key", *[F.col(c).alias(f"{k}{c}") for c in el.columns])
        out = out.join(part, "key", "left")
    return out.drop("key")


def collapse_constant_columns(lm: LabeledMatrix, axis: str) -> LabeledMatrix:
    """Move annotation columns holding one value into ``uns`` (``table-<axis>``).

    One aggregation finds minimum, maximum and count of every column; equal
    minimum and maximum with no nulls means one value.
    """
    from ..model import annotation
    from .nested import from_dict, union

    table = lm.axis(axis)
    cols = annotation(table)
    if not cols:
        return lm
    stats = table.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(c) for c in cols],
    ).first()
    constant = {
        c: stats[c]["lo"] for c in cols if stats["n"] and stats[c]["n"] == stats["n"] and stats[c]["lo"] == stats[c]["hi"]
    }
    if not constant:
        return lm
    moved = from_dict(lm.spark, {f"table-{axis}": constant})
    return lm.replace(**{axis: table.drop(*constant), "uns": union(lm.uns, moved)})
