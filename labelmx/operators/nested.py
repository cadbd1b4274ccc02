"""Nested metadata as a path table ``(path ARRAY<STRING>, value STRING)``.

``value`` is the JSON text of a leaf. ``merge`` combines many such tables path
by path, without ever holding one mapping in one place. A leaf that is a table or
a sparse matrix stays a DataFrame: it takes part as a row that names its input
(``placeholders``), and ``chosen_tables`` gives back those that won.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, Table
from ..plans.local import small_table

SCHEMA = "path array<string>, value string"
STRATEGIES = ("same", "unique", "first", "only")


def from_dict(spark: SparkSession, tree: Mapping) -> DataFrame:
    """Path table of a nested mapping; ``None`` leaves are skipped."""
    def leaves(node, path):
        for k, v in node.items():
            if isinstance(v, (Table, Graph, DataFrame)):
                raise TypeError(f"{'/'.join((*path, str(k)))} is a table: use split_tables")
            if hasattr(v, "tolist"):  # arrays and their scalars
                v = v.tolist()
            if isinstance(v, Mapping):
                yield from leaves(v, (*path, str(k)))
            elif v is not None:
                yield list((*path, str(k))), json.dumps(v, default=str)
    return small_table(spark, list(leaves(tree, ())), SCHEMA)


def split_tables(spark: SparkSession, tree: Mapping) -> tuple[DataFrame, dict[tuple[str, ...], Table | Graph]]:
    """Path table of the plain leaves, and the leaves that are a ``Table`` or a ``Graph``, by path."""
    tables: dict[tuple[str, ...], Table | Graph] = {}

    def plain(node, path):
        out = {}
        for k, v in node.items():
            at = (*path, str(k))
            if isinstance(v, (Table, Graph)):
                tables[at] = v
            else:
                out[str(k)] = plain(v, at) if isinstance(v, Mapping) else v
        return out

    return from_dict(spark, plain(tree, ())), tables


def placeholders(spark: SparkSession, held: Sequence[tuple[int, Mapping]], differing: Callable) -> DataFrame:
    """``(ds, path, value, cmp)``: a leaf for each input's tables; ``cmp`` is shared where all copies are equal.

    ``differing`` takes the copies by path and tells, in one job, which of them differ.
    """
    copies: dict = {}
    for ds, tables in held:
        for path, el in tables.items():
            copies.setdefault(json.dumps(path), []).append((ds, el))
    odd = differing({p: [el for _, el in at] for p, at in copies.items() if len(at) > 1})
    rows = [(ds, json.loads(path), _place(ds), f"table {ds if path in odd else ''}") for path, at in copies.items() for ds, _ in at]
    return small_table(spark, rows, "ds int, path array<string>, value string, cmp string")


def _place(ds: int) -> str:
    """Text of a leaf that stands for a table of input ``ds``; objects are never leaves otherwise."""
    return json.dumps({"table of input": ds})


def chosen_tables(merged: DataFrame, held: Sequence[tuple[int, Mapping]]) -> tuple[DataFrame, dict]:
    """The plain leaves of a merged path table, and the tables it chose by path."""
    places = {_place(ds): tables for ds, tables in held}
    is_place = F.col("value").isin(list(places))
    won = merged.where(is_place).collect()  # at most one row per table
    return merged.where(~is_place), {tuple(r.path): places[r.value][tuple(r.path)] for r in won}


def to_dict(table: DataFrame | None) -> dict:
    """Nested mapping of a path table (small metadata, read to the driver)."""
    out: dict = {}
    for path, value in [] if table is None else table.collect():
        node = out
        for k in path[:-1]:
            node = node.setdefault(k, {})
        node[path[-1]] = json.loads(value)
    return out


def union(*tables: DataFrame | None) -> DataFrame | None:
    out = None
    for t in tables:
        if t is not None:
            out = t if out is None else out.unionByName(t)
    return out


def _number(value: Column) -> Column:
    """Text of a number: whole ones as integers, so that none is rounded; null if it is no number."""
    x = value.try_cast("double")
    near = (F.abs(x) < F.lit(float(2**63))) & (x == F.floor(x).cast("double"))
    return (
        F.when(value.rlike(r"^-?\d{1,38}$"), value.try_cast("decimal(38,0)").cast("string"))
        .when(near, x.cast("bigint").cast("string"))
        .otherwise(x.cast("string"))
    )


def _flat(value: Column) -> Column:
    return F.when(value == "true", F.lit("1")).when(value == "false", F.lit("0")).otherwise(_number(value))


def comparable(value: Column) -> Column:
    """Text under which equal leaves compare equal: numbers by value, NaN only inside arrays."""
    flat = _flat(value)
    # arrays of numbers, of any depth: each number by its value, brackets and commas as they are
    numbers = value.rlike(r"^\[[\[\]\s,\d.eE+-]*([\[\s,]-?(NaN|Infinity|null|true|false)[\[\]\s,\d.eE+-]*)*\]$")
    token = lambda t: F.coalesce(_flat(t), t)
    pieces = F.split(F.regexp_replace(value, r"\s+", ""), r"(?<=[\[\],])|(?=[\[\],])")
    return (
        F.when(F.isnan(value.try_cast("double")), None)
        .when(flat.isNotNull(), flat)
        .when(numbers, F.array_join(F.transform(pieces, token), ""))
        .otherwise(value)
    )


def _verdicts(leaves: DataFrame, n_inputs: int, strategy: str) -> DataFrame:
    """Per path that is a leaf in some input: who wins, and whether it is kept."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.slice(F.col("path"), 1, i))
    nodes = leaves.select("ds", "cmp", "path", F.explode(prefixes).alias("node"))
    is_leaf = F.size("node") == F.size("path")
    # one row per (path, input) first: a mapping with very many leaves collapses map-side
    held = nodes.groupBy("node", "ds").agg(
        F.max(is_leaf).alias("leaf"), F.max(F.when(is_leaf, F.col("cmp"))).alias("cmp")
    )
    state = held.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_ds"),
        F.min("ds").alias("first_ds"),
        F.max("leaf").alias("terminal"),
        F.min("leaf").alias("all_leaves"),
        ((F.count("cmp") == F.count(F.lit(1))) & (F.min("cmp") == F.max("cmp"))).alias("equal"),
    )
    one = F.col("n_ds") == 1
    keep = {
        "same": (F.col("n_ds") == n_inputs) & (F.col("equal") | one),
        "unique": F.col("equal") | one,
        "first": F.lit(True),
        "only": one,
    }[strategy]
    return state.where("terminal").select(
        "node", "first_ds", F.coalesce(keep, F.lit(False)).alias("keep"), (~F.col("all_leaves")).alias("mixed")
    )


def merge(tagged: DataFrame, n_inputs: int, strategy: str | None, *, copies: int = 16) -> DataFrame:
    """Merge ``(ds, path, value)`` leaves of ``n_inputs`` mappings.

    Mappings present at a path are merged recursively. Where some input holds a
    leaf, the strategy decides: ``same`` needs equal leaves in every input,
    ``unique`` equal leaves where present, ``first`` takes the first input's
    (its whole subtree if it holds a mapping), ``only`` a path of one input.
    ``None`` keeps nothing.
    """
    if strategy is None:
        return tagged.select("path", "value").where(F.lit(False))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown merge strategy {strategy!r}")
    cmp = comparable(F.col("value"))
    if "cmp" in tagged.columns:  # placeholders bring their own
        cmp = F.coalesce("cmp", cmp)
    leaves = tagged.select("ds", "path", "value", cmp.alias("cmp"))
    verdicts = _verdicts(leaves, n_inputs, strategy)
    own = leaves.join(verdicts.withColumnRenamed("node", "path"), "path")
    # A mapping that meets a leaf of another input is decided at that path for all
    # its leaves. Such a path can cover most leaves, so the join is salted.
    salt = F.pmod(F.xxhash64("ds", "path"), F.lit(copies)).cast("int").alias("copy")
    inner = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("path") - 1)), lambda i: F.slice(F.col("path"), 1, i)
    )
    above = leaves.where(F.size("path") > 1).select("ds", "path", salt, F.explode(inner).alias("node"))
    clashes = verdicts.where("mixed").select(
        "node", "first_ds", "keep", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    )
    decided = (
        above.join(clashes, ["node", "copy"])
        .groupBy("ds", "path")
        .agg(F.min_by(F.struct("first_ds", "keep"), F.size("node")).alias("up"))
    )
    both = own.join(decided, ["ds", "path"], "left")
    wins = F.coalesce(F.col("up.keep") & (F.col("up.first_ds") == F.col("ds")),
                      F.col("keep") & (F.col("first_ds") == F.col("ds")))
    return both.where(wins).select("path", "value")
