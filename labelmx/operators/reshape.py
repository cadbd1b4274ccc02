"""Transpose, packing, dense/sparse conversion, chunks and samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import inflate
from ..functions.text import draw
from ..model import LabeledMatrix, Matrix
from ..plans.blocks import BLOCK_WIDTH, key_blocks, spread
from ..plans.ranks import ROWS_PER_BUCKET, numbered, ranked, whole_div
from .access import pick_matrix
from .select import by_positions


def transpose(lm: LabeledMatrix) -> LabeledMatrix:
    """Swap the axes by renaming columns; nothing is shuffled. Raw is dropped."""
    def swap(m: Matrix | None):
        if m is None:
            return None
        return Matrix(m.cells.select(F.col("var_key").alias("obs_key"), F.col("obs_key").alias("var_key"), "value"), m.absent)

    return LabeledMatrix(
        obs=lm.var, var=lm.obs, X=swap(lm.X), layers={k: swap(m) for k, m in lm.layers.items()},
        obsm=lm.varm, varm=lm.obsm, obsp=lm.varp, varp=lm.obsp, uns=lm.uns, uns_tables=lm.uns_tables,
        obs_categories=lm.var_categories, var_categories=lm.obs_categories,
        obs_dense=lm.var_dense, var_dense=lm.obs_dense,
    )


def _pack(lm: LabeledMatrix, m: Matrix, major: str, width: int, n_minor: int | None = None) -> DataFrame:
    minor = "var" if major == "obs" else "obs"
    place = lm.positions(minor, n_minor).select(F.col("key").alias(f"{minor}_key"), "pos")
    placed = m.cells.join(place, f"{minor}_key")
    block = whole_div(F.col("pos"), width)
    item = F.struct((F.col("pos") - block * width).cast("int").alias("off"), F.col("value"))
    return placed.groupBy(F.col(f"{major}_key").alias("key"), block.alias("block")).agg(
        F.sort_array(F.collect_list(item)).alias("packed")
    )


def pack_rows(lm: LabeledMatrix, *, layer: str | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Compressed rows ``(key, block, packed ARRAY<STRUCT<off, value>>)``.

    A row is cut into blocks of ``width`` neighbouring variables, so an array
    never holds more than ``width`` items however full the row is.
    """
    return _pack(lm, pick_matrix(lm, layer=layer), "obs", width)


def pack_cols(lm: LabeledMatrix, *, layer: str | None = None, width: int = BLOCK_WIDTH) -> DataFrame:
    """Compressed columns, cut into blocks of ``width`` neighbouring observations."""
    return _pack(lm, pick_matrix(lm, layer=layer), "var", width)


def unpack(lm: LabeledMatrix, packed: DataFrame, *, by_rows: bool = True, width: int = BLOCK_WIDTH, absent: float = 0.0) -> Matrix:
    """Cells of compressed rows or columns."""
    major, minor = ("obs", "var") if by_rows else ("var", "obs")
    items = packed.select(F.col("key").alias(f"{major}_key"), "block", F.inline("packed"))
    place = lm.positions(minor).select(F.col("key").alias(f"{minor}_key"), "pos")
    cells = items.withColumn("pos", F.col("block") * width + F.col("off")).join(place, "pos")
    return Matrix(cells.select("obs_key", "var_key", "value"), absent)


def pack_dense(lm: LabeledMatrix, *, layer: str | None = None, width: int = BLOCK_WIDTH, n_vars: int | None = None) -> DataFrame:
    """Dense rows ``(obs_key, block, keys, values)``: every cell, in arrays of ``width``.

    Only stored cells and block arrays are shuffled; gaps are filled in place.
    """
    m = pick_matrix(lm, layer=layer)
    n_vars = lm.var.count() if n_vars is None else n_vars
    blocks = key_blocks(lm.positions("var", n_vars), pos="pos", width=width)
    grid = spread(lm.obs.select(F.col("key").alias("obs_key")), blocks, n_vars, width=width)
    packed = _pack(lm, m, "obs", width, n_vars).withColumnRenamed("key", "obs_key")
    full = grid.join(packed, ["obs_key", "block"], "left")
    empty = F.array().cast(packed.schema["packed"].dataType)
    values = inflate(F.coalesce("packed", empty), F.size("keys"), m.absent)
    return full.select("obs_key", "block", "keys", values.alias("values"))


def densify(lm: LabeledMatrix, *, layer: str | None = None, width: int = BLOCK_WIDTH) -> Matrix:
    """Every cell written out; cells that were absent hold the absent value."""
    m = pick_matrix(lm, layer=layer)
    kind = m.cells.schema["value"].dataType
    rows = pack_dense(lm, layer=layer, width=width)
    pairs = rows.select("obs_key", F.explode(F.arrays_zip("keys", "values")).alias("c"))
    cells = pairs.select("obs_key", F.col("c.keys").alias("var_key"), F.col("c.values").cast(kind).alias("value"))
    return Matrix(cells, float("nan"))


WORD = 64


def gaps(lm: LabeledMatrix, m: Matrix, *, width: int = BLOCK_WIDTH) -> DataFrame:
    """``(obs_key, var_key)`` of the cells on ``lm``'s axes that ``m`` does not store.

    Stored cells only leave a bit each: presence is kept in words of 64 bits per
    (row, word), and the words of a block meet its key array. Where they are all
    set nothing is unfolded, else just the missing keys are.
    """
    n_vars = lm.var.count()
    place = lm.positions("var", n_vars).select(F.col("key").alias("var_key"), "pos")
    held = m.cells.select("obs_key", "var_key").join(place, "var_key")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(WORD)).cast("int"))
    word = F.pmod(whole_div(F.col("pos"), WORD), F.lit(width // WORD)).cast("int")
    words = held.groupBy("obs_key", whole_div(F.col("pos"), width).alias("block"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    present = words.groupBy("obs_key", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"), F.sum(F.bit_count("bits")).alias("n")
    )
    blocks = key_blocks(lm.positions("var", n_vars), pos="pos", width=width)
    grid = spread(lm.obs.select(F.col("key").alias("obs_key")), blocks, n_vars, width=width)
    open_ = grid.join(present, ["obs_key", "block"], "left").where(F.coalesce("n", F.lit(0)) < F.size("keys"))
    listed = F.transform(F.sequence(F.lit(0), F.lit(width // WORD - 1)), lambda w: F.coalesce(F.try_element_at("words", w), F.lit(0)))
    absent = lambda k, i: F.getbit(F.get("_bits", (i / WORD).cast("int")), F.pmod(i, F.lit(WORD))) == 0
    missing = open_.withColumn("_bits", listed).withColumn("_missing", F.filter("keys", absent))
    return missing.select("obs_key", F.explode("_missing").alias("var_key"))


def sparsify(m: Matrix, lm: LabeledMatrix | None = None) -> Matrix:
    """Only non-zero cells are kept; NaN and NULL are not zero.

    Where absent cells mean NaN, those on the axes of ``lm`` are stored as NaN.
    Without ``lm`` nothing says which cells are absent, so such a matrix stays
    as it is and loses none.
    """
    if m.absent != 0 and lm is None:
        return m
    kept = m.cells.where((F.col("value") != 0) | F.col("value").isNull())
    if m.absent != 0:
        kind = m.cells.schema["value"].dataType
        kept = kept.unionByName(gaps(lm, m).withColumn("value", F.lit(m.absent).cast(kind)))
    return Matrix(kept, 0.0)


def blocks_of(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, stop)`` of contiguous blocks of ``size``; the last one may be short."""
    return [(s, min(s + size, n)) for s in range(0, max(n, 1), size)]


def block_grid(lm: LabeledMatrix, *, axis: str, size: int) -> DataFrame:
    """Axis table with ``block``, ``start`` and ``stop`` of contiguous blocks of ``size``."""
    n = lm.axis(axis).count()
    block = whole_div(F.col("pos"), size)
    return lm.positions(axis, n).select(
        "*", block.alias("block"), (block * size).alias("start"),
        F.least(block * size + size, F.lit(n)).alias("stop"),
    )


def map_chunks(
    lm: LabeledMatrix,
    fn: Callable,
    schema: str,
    *,
    chunk_size: int = 6000,
    layer: str | None = None,
    var_block: int = BLOCK_WIDTH,
) -> DataFrame:
    """Apply ``fn`` to row chunks and collect its frames.

    ``fn(values, start, end, var_start)`` gets the dense values of rows
    ``start … end-1`` as a 2-D array and returns a pandas frame of ``schema``.
    Matrices wider than ``var_block`` come in tiles, so a task never holds more
    than ``chunk_size × var_block`` values.
    """
    import numpy as np

    place = lm.positions("obs").select(F.col("key").alias("obs_key"), F.col("pos").alias("row"))
    rows = pack_dense(lm, layer=layer, width=var_block).join(place, "obs_key")
    tiles = rows.select(whole_div(F.col("row"), chunk_size).alias("chunk"), "block", "row", "values")

    def one(ids, pdf):
        pdf = pdf.sort_values("row")
        start = int(ids[0]) * chunk_size
        return fn(np.stack(pdf["values"].to_numpy()), start, start + len(pdf), int(ids[1]) * var_block)

    return tiles.groupBy("chunk", "block").applyInPandas(one, schema)


def _drawn_keys(lm: LabeledMatrix, k: int, seed: int) -> DataFrame:
    """``(key, new_key)`` of the ``k`` rows whose hashes of key and seed come first.

    Up to ``ROWS_PER_BUCKET`` of them come from each task's own first ``k``;
    more are numbered in range parts, by the same order.
    """
    hashed = F.concat_ws(":", F.md5(F.concat_ws(":", F.col("key").cast("string"), F.lit(str(seed)))), F.col("key"))
    drawn = lm.obs.select("key", hashed.alias("_draw"))
    if k > ROWS_PER_BUCKET:
        return numbered(drawn, "_draw", out="new_key").where(F.col("new_key") < k).select("key", "new_key")
    return ranked(drawn.orderBy("_draw").limit(k), "_draw", "new_key", n_rows=k).select("key", "new_key")


def _drawn_positions(lm: LabeledMatrix, k: int, n: int, seed: int) -> DataFrame:
    ids = lm.spark.range(k)
    return ids.select((draw(seed, F.col("id")) % F.lit(max(n, 1))).alias("pos"), F.col("id").alias("new_key"))


def sample_positions(lm: LabeledMatrix, select: int = 1000, *, replace: bool = True, seed: int = 0) -> DataFrame:
    """Random row positions ``(pos, new_key)``, capped at ``n_obs`` rows.

    Draws are hashes of the draw number (with replacement) or of the row key, so
    recomputing a lost task gives the same sample.
    """
    n = lm.obs.count()
    k = min(select, n)
    if replace:
        return _drawn_positions(lm, k, n, seed)
    return lm.positions("obs", n).join(_drawn_keys(lm, k, seed), "key").select("pos", "new_key")


def take_rows(lm: LabeledMatrix, positions: DataFrame, *, layer: str | None = None) -> LabeledMatrix:
    """Rows at ``positions(pos, new_key)``, order and repeats kept, as a dense matrix."""
    from .select import apply

    n = lm.obs.count()
    sub = apply(lm, "obs", by_positions(lm.positions("obs", n), positions, n))
    dense = densify(sub, layer=layer)
    return sub.replace(X=dense, layers={})


def sample_rows(lm: LabeledMatrix, select: int = 1000, *, replace: bool = True, seed: int = 0, layer: str | None = None) -> LabeledMatrix:
    """Random rows as a dense matrix; without replacement no row needs a position."""
    from .select import apply, by_keys

    n = lm.obs.count()
    if replace:
        return take_rows(lm, _drawn_positions(lm, min(select, n), n, seed), layer=layer)
    sub = apply(lm, "obs", by_keys(lm.obs, _drawn_keys(lm, min(select, n), seed)))
    return sub.replace(X=densify(sub, layer=layer), layers={})


def read_as_sparse(lm: LabeledMatrix, names=("X",)) -> LabeledMatrix:
    """Turn a densely stored ``X`` / ``raw/X`` sparse; other names are rejected."""
    from ..model import Raw

    for name in names:
        if name == "X":
            lm = lm.replace(X=sparsify(lm.X, lm))
        elif name == "raw/X":
            if lm.raw is None:
                raise ValueError("cannot convert raw/X: there is no raw")
            held = lm.replace(var=lm.raw.var, var_dense=lm.raw.var_dense)
            lm = lm.replace(raw=Raw(sparsify(lm.raw.X, held), lm.raw.var, lm.raw.varm, lm.raw.var_dense))
        else:
            raise NotImplementedError(f"only X and raw/X can be converted, not {name!r}")
    return lm
