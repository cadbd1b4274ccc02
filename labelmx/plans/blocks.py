"""Axis blocks: runs of neighbouring keys packed in arrays of bounded length.

Dense results need every (row, column) cell. They are produced by giving each
row the handful of key blocks of the other axis and unfolding the arrays in
place, so only stored cells and block arrays are shuffled, never the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked, whole_div

BLOCK_WIDTH = 4096
# Arrays of 8-byte keys; beyond this the block table is shuffled, not broadcast.
BROADCAST_KEYS = 4_000_000


def key_blocks(
    axis: DataFrame, by: Sequence[str] = (), *, pos: str | None = None, width: int = BLOCK_WIDTH, n_keys: int | None = None
) -> DataFrame:
    """``(by…, block, keys)`` with at most ``width`` keys per block, in order."""
    placed = axis if pos else ranked(axis, "ord", "_pos", by, n_rows=n_keys)
    pos = pos or "_pos"
    return (
        placed.groupBy(*by, whole_div(F.col(pos), width).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col("key").alias("key")))).alias("_k"))
        .select(*by, "block", F.col("_k.key").alias("keys"))
    )


def spread(
    rows: DataFrame,
    blocks: DataFrame,
    n_keys: int,
    by: Sequence[str] = (),
    *,
    width: int = BLOCK_WIDTH,
    broadcast_keys: int = BROADCAST_KEYS,
    copies: int = 64,
) -> DataFrame:
    """Give every row each block of its group: ``rows × blocks`` rows.

    ``n_keys`` is the counted number of keys in ``blocks``, ``width`` their width. Small block tables
    are broadcast; larger ones are copied ``copies`` times so that the rows of
    one group, or of one block, spread over as many tasks.
    """
    by = list(by)
    if by:
        ids = blocks.groupBy(*by).agg(F.collect_list("block").alias("_ids"))
        listed = rows.join(F.broadcast(ids), by)  # one row per input
    else:
        n_blocks = -(-n_keys // width)
        ids = F.sequence(F.lit(0), F.lit(n_blocks - 1)) if n_blocks else F.array()
        listed = rows.withColumn("_ids", ids.cast("array<bigint>"))
    each = listed.withColumn("block", F.explode("_ids")).drop("_ids")
    if n_keys <= broadcast_keys:
        return each.join(F.broadcast(blocks), [*by, "block"])
    salted = each.withColumn("_copy", F.pmod(F.xxhash64(*rows.columns), F.lit(copies)).cast("int"))
    copied = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return salted.join(copied, [*by, "block", "_copy"]).drop("_copy")
