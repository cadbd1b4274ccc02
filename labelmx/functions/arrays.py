"""Array expressions for vectors and packed rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inflate(packed: Column, width: Column | int, fill: float) -> Column:
    """Dense array of ``width`` from a sorted array of ``struct(off, value)``.

    Gaps are filled run by run, so the cost is the array length, not the
    number of lookups.
    """
    gap = lambda n: F.array_repeat(F.lit(float(fill)), n.cast("int"))
    width = F.lit(width) if isinstance(width, int) else width
    last_end = F.coalesce(F.try_element_at(packed, F.lit(-1))["off"] + 1, F.lit(0))
    pieces = F.transform(
        packed,
        lambda x, i: F.concat(
            gap(x["off"] - F.coalesce(F.get(packed, i - 1)["off"] + 1, F.lit(0))),
            F.array(x["value"].cast("double")),
        ),
    )
    return F.concat(F.flatten(pieces), gap(width - last_end))


def fit(vec: Column, width: int, fill: float | None = None) -> Column:
    """Truncate a vector to ``width``, or pad it with ``fill``."""
    padded = F.concat(vec, F.array_repeat(F.lit(fill).cast("double"), F.greatest(F.lit(0), F.lit(width) - F.size(vec))))
    return F.slice(padded, 1, width)


def flatten_columns(name: str, vec: Column, width: int) -> list[Column]:
    """Columns ``name1 … nameN`` of a vector."""
    return [F.get(vec, F.lit(i)).alias(f"{name}{i + 1}") for i in range(width)]
