"""Delimited text matrices, UMI count tables and Matrix Market files.

A path is one file or a directory of part files in name order. The driver looks
at the first lines only, to decide about headers and names; all lines are parsed
by the executors and numbered without an exchange.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import unquote
from ..model import LabeledMatrix, Matrix, axis_table
from ..operators.reshape import densify
from ..plans.durable import stored
from ..plans.local import small_table
from ..plans.ranks import ranked, whole_div


@dataclass(frozen=True)
class Lines:
    """Non-empty lines ``(at, value)``, numbered from 0 in file order, and the first non-empty file."""

    df: DataFrame
    first: str

    def after(self, n: int) -> DataFrame:
        """All but the first ``n`` lines, numbered from 0."""
        # the value depends on the number too: casts of it are never tried on the lines before
        return self.df.where(F.col("at") >= n).select((F.col("at") - n).alias("at"), F.when(F.col("at") >= n, F.col("value")).alias("value"))


def open_lines(spark: SparkSession, path: str, fields: Mapping[str, Column] | None = None) -> Lines:
    """Lines of a file or directory; ``.gz`` and ``.bz2`` are decompressed by suffix.

    With ``fields`` each line is cut into those columns of ``value`` as it is read, and they take its place.

    Lines are written once as they are read, with their split and their place in
    it, so that every later plan sees the same splits and a compressed file is
    unpacked once and then parsed in parallel. A line's number is the lines of the
    splits before its own plus its place: one small row per split is broadcast,
    the lines themselves are never exchanged.
    """
    raw = spark.read.text(path)
    shown = ["value"] if fields is None else [c.alias(name) for name, c in fields.items()]
    files = sorted(raw.inputFiles())
    first = next((f for f in files if not spark.read.text(f).where("value <> ''").isEmpty()), None)
    if first is None:
        raise ValueError(f"no data in {path}")
    read = stored(raw.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), "value",
    ).where(F.col("value") != "").select("file", "path", "start", F.monotonically_increasing_id().alias("line"), *shown), "lines")
    splits = read.groupBy("file", "path", "start").agg(F.min("line").alias("low"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as the input has splits: a few bytes for every 128 MB
    shift = stored(splits.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift")), "splits")
    numbered = read.join(F.broadcast(shift), ["file", "start"]).select((F.col("line") + F.col("shift")).alias("at"), *(fields or ["value"]))
    return Lines(numbered, first)


def _is_float(token: str) -> bool:
    try:
        float(token)
        return True
    except ValueError:
        return False


def _head(spark: SparkSession, lines: Lines, wanted: int, comment: str) -> list[str]:
    """First lines of the first file: at least ``wanted`` that are no comments, if there are."""
    source = spark.read.text(lines.first).where("value <> ''")
    size = 200
    while True:
        rows = [r.value for r in source.limit(size).collect()]
        if len(rows) < size or sum(not r.startswith(comment) for r in rows) >= wanted:
            return rows
        size *= 10


def _split(value, delimiter: str | None):
    if delimiter is None:
        return F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+")
    return F.split(value, re.escape(delimiter))


def read_text(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    first_column_names: bool | None = None,
    dtype: str = "float",
) -> LabeledMatrix:
    """A text matrix.

    ``#`` lines before the data are comments. The first data line is a header if
    its last token is no number; without one the last comment names the columns,
    else they are numbered. Row names are taken from the first column if asked
    for or if the first token of one of the first two data lines is no number. A
    first line of numbers whose length differs from the second is a header too.
    ``delimiter=None`` splits at runs of white space.
    """
    lines = open_lines(spark, path)
    head = _head(spark, lines, 3, "#")
    first = next((i for i, r in enumerate(head) if not r.startswith("#")), None)
    if first is None:
        raise ValueError(f"no data in {path}")
    comments = [c for c in (r.lstrip("# ") for r in head[:first]) if c]
    data = head[first:]
    if delimiter is not None and delimiter not in data[0]:
        raise ValueError(f"{path}: its first data row holds no delimiter {delimiter!r}")
    tokens = [r.split(delimiter) for r in data[:3]]
    named = first_column_names
    header: list[str] = []
    if not _is_float(tokens[0][-1]):
        header, skipped = tokens[0], first + 1
        rows = tokens[1:]
        named = bool(named) or (bool(rows) and not _is_float(rows[0][0]))
    else:
        rows, skipped = tokens, first
        named = bool(named) or not _is_float(rows[0][0])
        second_named = len(rows) > 1 and (named or not _is_float(rows[1][0]))
        width = len(rows[0]) - int(named)
        if len(rows) > 1 and width != len(rows[1]) - int(second_named):
            # a header of numbers above rows that start with a numeric name
            header = [str(int(float(t))) for t in rows[0][int(named):]]
            skipped, named, rows = first + 1, True, rows[1:]
        else:
            named = second_named or named
    if not rows:
        raise ValueError(f"no data in {path}")
    width = len(rows[0]) - int(named)
    names = header or (comments[-1].split() if comments else [str(i) for i in range(width)])
    names = [n.strip('"') for n in (names[1:] if len(names) > width else names)]
    if len(names) != width:
        raise ValueError(f"{len(names)} column names for {width} columns")

    parts = lines.after(skipped).select(F.col("at").alias("key"), _split(F.col("value"), delimiter).alias("t"))
    skip = int(named)
    size = F.size("t") - skip
    checked = F.when(size == width, F.slice("t", skip + 1, width)).otherwise(
        F.raise_error(F.concat(F.lit(f"the first row has {width} values, row "), "key", F.lit(" has "), size))
    )
    name = unquote(F.col("t")[0]) if named else F.col("key").cast("string")
    obs = parts.select("key", F.col("key").alias("ord"), name.alias("name"))
    var = small_table(spark, [(i, i, n) for i, n in enumerate(names)], "key bigint, ord bigint, name string")
    cells = parts.select(F.col("key").alias("obs_key"), F.posexplode(checked).alias("v", "token")).select(
        "obs_key", F.col("v").cast("bigint").alias("var_key"), F.trim("token").cast(dtype).alias("value")
    )
    return LabeledMatrix(obs, var, Matrix(cells, float("nan")), obs_dense=True, var_dense=True)


def read_csv(
    spark: SparkSession, path: str, delimiter: str = ",", first_column_names: bool | None = None, dtype: str = "float"
) -> LabeledMatrix:
    """``read_text`` with a comma as delimiter."""
    return read_text(spark, path, delimiter, first_column_names, dtype)


def umi_matrix(rows: DataFrame, order: str = "at", dtype: str = "float", *, dense: bool = False) -> LabeledMatrix:
    """Counts ``(gene, cell, count, <order>)`` as cells × genes; ``order`` is a number.

    Of repeated pairs the last one counts; pairs without a row are 0. Cells and
    genes are in first-seen order.
    """
    def axis(col: str) -> DataFrame:
        # counted, dealt and written below: the rows are gone through once
        seen = stored(rows.groupBy(F.col(col).alias("name")).agg(F.min(order).alias("first")), "seen")
        # two names can start on one line only if they are on different axes
        return ranked(seen, "first", "key").select("key", F.col("key").alias("ord"), "name")

    obs, var = axis("cell"), axis("gene")
    last = rows.groupBy("cell", "gene").agg(F.max_by("count", order).alias("value"))
    cells = (
        last.join(obs.select(F.col("key").alias("obs_key"), F.col("name").alias("cell")), "cell")
        .join(var.select(F.col("key").alias("var_key"), F.col("name").alias("gene")), "gene")
        .select("obs_key", "var_key", F.col("value").cast(dtype).alias("value"))
    )
    lm = LabeledMatrix(obs, var, Matrix(cells, 0.0), obs_dense=True, var_dense=True)
    return lm.replace(X=densify(lm)) if dense else lm


def read_umi_counts(spark: SparkSession, path: str, dtype: str = "float", *, dense: bool = False) -> LabeledMatrix:
    """A tab-separated ``gene, cell, count`` table (often gzipped); its first line is a header."""
    t = F.split("value", "\t")
    lines = open_lines(spark, path, {"gene": t[0], "cell": F.get(t, F.lit(1)), "count": F.get(t, F.lit(2))}).df.where("at >= 1")
    # what is asked of a line depends on its number too: the header may hold anything
    held = lambda c: F.when(F.col("at") >= 1, F.coalesce(c, F.raise_error(F.concat(F.lit(f"no {c} in line "), "at"))))
    rows = lines.select("gene", held("cell").alias("cell"), F.trim(held("count")).cast("bigint").alias("count"), (F.col("at") - 1).alias("at"))
    return umi_matrix(rows, "at", dtype, dense=dense)


def read_mtx(spark: SparkSession, path: str, dtype: str = "float") -> LabeledMatrix:
    """A Matrix Market file as sparse matrix with numbered names.

    Coordinate and array formats; real, integer and pattern fields; general,
    symmetric and skew-symmetric storage.
    """
    lines = open_lines(spark, path)
    head = _head(spark, lines, 1, "%")
    banner = head[0].lower().split()
    if not banner or not banner[0].startswith("%%matrixmarket"):
        raise ValueError(f"{path} is not a Matrix Market file")
    layout, field, symmetry = banner[2:5]
    if field == "complex" or symmetry == "hermitian":
        raise NotImplementedError(f"{field} {symmetry} matrices are not supported")
    at = next(i for i, r in enumerate(head) if not r.startswith("%") and r.strip())
    shape = [int(x) for x in head[at].split()]
    body = lines.after(at + 1).where(F.trim("value") != "")
    t = _split(F.col("value"), None)
    if layout == "coordinate":
        value = F.lit(1.0) if field == "pattern" else t[2].cast("double")
        cells = body.select((t[0].cast("bigint") - 1).alias("obs_key"), (t[1].cast("bigint") - 1).alias("var_key"), value.alias("value"))
    elif symmetry == "general":
        placed = ranked(body, "at", "pos")  # blank lines inside the body leave gaps
        cells = placed.select((F.col("pos") % shape[0]).alias("obs_key"), whole_div(F.col("pos"), shape[0]).alias("var_key"), F.trim("value").cast("double").alias("value"))
        cells = cells.where("value <> 0")
    else:
        raise NotImplementedError("array format is only read in general storage")
    if symmetry != "general":
        sign = -1 if symmetry == "skew-symmetric" else 1
        # one pass: an off-diagonal line gives both its cells
        both = F.array(
            F.struct("obs_key", "var_key", "value"),
            F.struct(F.col("var_key").alias("obs_key"), F.col("obs_key").alias("var_key"), (F.col("value") * sign).alias("value")),
        )
        kept = F.when(F.col("obs_key") == F.col("var_key"), F.slice(both, 1, 1)).otherwise(both)
        cells = cells.select(F.inline(kept))
    # repeated coordinates add up
    cells = cells.groupBy("obs_key", "var_key").agg(F.sum("value").cast(dtype).alias("value"))
    numbered = lambda n: axis_table(spark.range(n).toDF("key"), key="key")
    return LabeledMatrix(numbered(shape[0]), numbered(shape[1]), Matrix(cells, 0.0), obs_dense=True, var_dense=True)
