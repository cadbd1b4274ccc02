"""Order-preserving ranks and running totals without a one-task global sort.

The rows are dealt by one range exchange on their order, sorted inside each
part and written with the part's number and their place in it. What is written
stays as it is, whatever is lost later, so the number of a row is the rows in
the parts before its own plus its place: a sum over one small row per part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import stored

#: Up to so many rows, one task sorts them all.
ROWS_PER_BUCKET = 250_000
#: Parts of an exchange at most; larger parts sort with spilling.
MAX_PARTS = 20_000
_PART, _AT = "_part", "_at_part"


def whole_div(value: Column, size: int) -> Column:
    """Integer division that stays exact for any BIGINT."""
    return F.call_function("div", value, F.lit(size))


def in_parts(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """``df`` in range parts along ``order``, written with ``_part`` and the place ``_at_part`` of each row in it."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    number = F.monotonically_increasing_id()
    return stored(dealt.sortWithinPartitions(*keys).select(
        *[F.col(f"`{c}`") for c in df.columns], F.shiftright(number, 33).cast("int").alias(_PART),
        number.bitwiseAND(F.lit((1 << 33) - 1)).alias(_AT),
    ), "ordered")


def _before() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, *order: Column | str, out: str = "pos", parts: int | None = None) -> DataFrame:
    """Add ``out``: the 0-based rank of each row along ``order``, ties in any order; one exchange."""
    table = in_parts(df, *order, parts=parts)
    counts = table.groupBy(_PART).agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(_PART, F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_shift"))
    # one row per part of an exchange
    return table.join(F.broadcast(shift), _PART).withColumn(out, F.col(_AT) + F.col("_shift")).drop(_PART, _AT, "_shift")


def _parts(n: int, rows_per_bucket: int | None) -> int:
    """How many parts ``n`` rows need; one, if a task may sort them all."""
    return min(MAX_PARTS, math.ceil(n / (rows_per_bucket or ROWS_PER_BUCKET)))


def running_total(
    df: DataFrame,
    order: str,
    value: Column,
    out: str,
    by: Sequence[str] = (),
    *,
    n_rows: int | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add ``out``: the inclusive running sum of ``value`` along ``order`` per ``by``.

    A group holding most rows is spread over many parts, so no task has to sort
    it whole. ``order`` must be unique inside a group.
    """
    by = list(by)
    parts = _parts(df.count() if n_rows is None else n_rows, rows_per_bucket)
    group = by or [F.lit(0)]
    if parts <= 1:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(w))
    table = in_parts(df.withColumn("_amount", value), *by, order, parts=parts)
    totals = table.groupBy(*by, _PART).agg(F.sum("_amount").alias("_total"))
    before = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a part can have begun in an earlier one: at most one row per part
    shift = totals.withColumn("_shift", F.sum("_total").over(before)).where("_shift IS NOT NULL")
    shift = shift.select("_shift", F.col(_PART).alias("_in"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)])
    inside = Window.partitionBy(*by, _PART).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(_PART) == F.col("_in"), *[F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]]
    moved = table.join(F.broadcast(shift), same, "left").drop("_in", *[f"_by{i}" for i in range(len(by))])
    return moved.withColumn(out, F.sum("_amount").over(inside) + F.coalesce("_shift", F.lit(0))).drop(_PART, _AT, "_amount", "_shift")


def ranked(
    df: DataFrame,
    order: str,
    out: str = "pos",
    by: Sequence[str] = (),
    *,
    n_rows: int | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Add ``out``: the 0-based rank of each row along ``order`` (per ``by``)."""
    one = F.lit(1).cast("bigint")
    if by:
        total = running_total(df, order, one, out, by, n_rows=n_rows, rows_per_bucket=rows_per_bucket)
        return total.withColumn(out, F.col(out) - 1)
    n = df.count() if n_rows is None else n_rows
    parts = _parts(n, rows_per_bucket)
    if parts > 1:
        return numbered(df, order, out=out, parts=parts)
    total = running_total(df, order, one, out, n_rows=n, rows_per_bucket=rows_per_bucket)
    return total.withColumn(out, F.col(out) - 1)


def sort_text(*cols: Column) -> Column:
    """One string that sorts like the given non-negative integer columns."""
    return F.concat(*[F.lpad(c.cast("string"), 20, "0") for c in cols])
