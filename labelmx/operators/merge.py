"""Merging elements that do not lie on the stacked axis.

Each element present in several inputs is aligned to the merged names and then
kept or dropped as a whole by a strategy. Annotation columns are compared with
NaN/null unequal; vectors, tables and graphs with NaN equal to NaN. A ``ByValues``
strategy looks at the values instead and may give values of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import ranked, sort_text
from .by_values import ByValues, merged_columns
from .compare import differing_columns


def shared_keys(mappings: Sequence[Mapping | Sequence[str]]) -> list[str]:
    """Keys of every mapping, in first-seen order."""
    return [k for k in all_keys(mappings) if all(k in m for m in mappings)]


def all_keys(mappings: Sequence[Mapping | Sequence[str]]) -> list[str]:
    """Keys of any mapping, in first-seen order."""
    return list(dict.fromkeys(k for m in mappings for k in m))


def key_order(tagged: DataFrame, n_inputs: int, how: str) -> DataFrame:
    """``(key, pos)``: the keys of any input, or of every input, in first-seen order.

    The table form of ``all_keys`` / ``shared_keys`` for ``(ds, at, key)`` rows,
    where ``at`` orders the keys of one input.
    """
    seen = tagged.groupBy("key").agg(
        F.count_distinct("ds").alias("n"), F.min(sort_text(F.col("ds"), F.col("at"))).alias("first")
    )
    if how == "shared":
        seen = seen.where(F.col("n") == n_inputs)
    return ranked(seen, "first", "pos").select("key", "pos")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def decide(strategy, present: Mapping[str, Sequence[int]], n_inputs: int, differing: Callable[[list[str]], set[str]]) -> dict[str, int]:
    """``element -> input`` to keep.

    ``present`` lists the inputs holding each element. ``differing`` is asked only
    for elements whose copies must be compared, and runs one job for all of them.
    A callable strategy gets ``(present, n_inputs)`` and returns the same mapping.
    """
    if strategy is None:
        return {}
    if callable(strategy):
        return dict(strategy(present, n_inputs))
    if strategy == "first":
        return {k: ds[0] for k, ds in present.items()}
    if strategy == "only":
        return {k: ds[0] for k, ds in present.items() if len(ds) == 1}
    if strategy == "same":
        present = {k: ds for k, ds in present.items() if len(ds) == n_inputs}
    elif strategy != "unique":
        raise ValueError(f"unknown merge strategy {strategy!r}")
    compare = [k for k, ds in present.items() if len(ds) > 1]
    bad = differing(compare) if compare else set()
    return {k: ds[0] for k, ds in present.items() if k not in bad}


def merge_columns(tables: Sequence[DataFrame], target: DataFrame, strategy, columns: Sequence[Sequence[str]]) -> DataFrame:
    """Annotation of the aligned axis: ``target(key, ord, name)`` plus the kept columns.

    ``columns`` lists the annotation columns of each table. Columns taken from
    the same input are attached with one join.
    """
    names = all_keys(columns)
    present = {c: [i for i, cs in enumerate(columns) if c in cs] for c in names}
    numbered = list(enumerate(tables))
    if isinstance(strategy, ByValues):
        return merged_columns(strategy, numbered, target, present)
    chosen = decide(strategy, present, len(tables), lambda cs: differing_columns(numbered, target, cs))
    return attach_columns(tables, target, [(i, c, c) for c, i in chosen.items()])


def attach_columns(tables: Sequence[DataFrame], target: DataFrame, picks: Sequence[tuple[int, str, str]]) -> DataFrame:
    """``target`` plus columns ``(input, column, new name)``, aligned by name."""
    out = target
    for i in dict.fromkeys(p[0] for p in picks):
        mine = [(c, new) for ds, c, new in picks if ds == i]
        out = out.join(tables[i].select("name", *[F.col(c).alias(new) for c, new in mine]), "name", "left")
    return out.select(*target.columns, *[new for _, _, new in picks])


def merge_outer_suffix(
    tables: Sequence[DataFrame], target: DataFrame, keys: Sequence[str], columns: Sequence[Sequence[str]], strategy="unique",
    sep: str = "-", *, inputs: Sequence[int] | None = None,
) -> DataFrame:
    """Columns kept by the strategy keep their name, all others appear once per input as ``col-key``.

    Kept columns come first; the others follow column by column, or input by
    input in the order of ``inputs``.
    """
    names = all_keys(columns)
    present = {c: [i for i, cs in enumerate(columns) if c in cs] for c in names}
    numbered = list(enumerate(tables))
    chosen = decide(strategy, present, len(tables), lambda cs: differing_columns(numbered, target, cs))
    single = [(c, i) for c in names if c not in chosen for i in present[c]]
    if inputs is not None:
        single.sort(key=lambda pick: inputs.index(pick[1]))
    picks = [(chosen[c], c, c) for c in names if c in chosen] + [(i, c, f"{c}{sep}{keys[i]}") for c, i in single]
    return attach_columns(tables, target, picks)
