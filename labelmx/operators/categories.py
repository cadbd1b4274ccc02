"""Categorical columns: a text column plus a dictionary table ``(code, category)``."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..model import Categories, LabeledMatrix, annotation, is_text
from ..plans.durable import stored
from ..plans.local import small_table
from ..plans.ranks import ranked


def dictionary(table: DataFrame, column: str, *, ordered: bool = False) -> Categories:
    """Naturally sorted dictionary of a column's distinct non-null values."""
    values = table.select(F.col(column).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    n = values.count()
    coded = ranked(values.withColumn("_nat", natural_key(F.col("category"))), "_nat", "code", n_rows=n)
    return Categories(coded.select(F.col("code").cast("int").alias("code"), "category"), ordered, size=n)


def category_values(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of several text columns, in one aggregation.

    Values collapse map-side, so a value held by most rows costs one row per task.
    """
    pairs = table.select(*cols).unpivot([], list(cols), "column", "value")
    return pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def strings_to_categories(lm: LabeledMatrix, axes: Sequence[str] = ("obs", "var")) -> LabeledMatrix:
    """Make text columns categorical where they have fewer categories than rows."""
    for axis in axes:
        table = lm.axis(axis)
        held = getattr(lm, f"{axis}_categories")
        cols = [c for c in annotation(table) if is_text(table, c) and c not in held]
        if not cols:
            continue
        values = stored(category_values(table, cols), "values")  # one pass over the axis
        counts = values.groupBy("column").agg(F.count("value").alias("n_categories"), F.sum("n").alias("n_rows")).collect()
        few = {r.column: r.n_categories for r in counts if r.n_categories < r.n_rows}
        named = values.where("value IS NOT NULL").select("column", F.col("value").alias("category"))
        made = {}
        for c in (c for c in cols if c in few):
            nat = named.where(F.col("column") == c).withColumn("_nat", natural_key(F.col("category")))
            coded = ranked(nat, "_nat", "code", n_rows=few[c])
            made[c] = Categories(coded.select(F.col("code").cast("int").alias("code"), "category"), size=few[c])
        lm = lm.replace(**{f"{axis}_categories": {**held, **made}})
    return lm


def encode_categories(table: DataFrame, column: str, cats: Categories) -> DataFrame:
    """The column as integer codes; missing or unknown values get -1."""
    codes = cats.table.select(F.col("category").alias(column), F.col("code").alias("_code"))
    joined = table.withColumn(column, F.col(column).cast("string")).join(codes, column, "left")
    code = F.coalesce("_code", F.lit(-1)).cast("int").alias(column)
    return joined.select(*[code if c == column else F.col(c) for c in table.columns])


def decode_categories(table: DataFrame, column: str, cats: Categories) -> DataFrame:
    """Codes back to values; -1 is missing.

    A dictionary too short for the codes is not applied and the codes stay.
    """
    top = table.agg(F.max(column)).first()[0]
    if top is not None and top >= cats.table.count():
        return table
    values = cats.table.select(F.col("code").alias(column), "category")
    joined = table.join(values, column, "left")
    return joined.select(*[F.col("category").alias(column) if c == column else F.col(c) for c in table.columns])


def set_palette(lm: LabeledMatrix, axis: str, column: str, colors: Sequence[str] | str) -> LabeledMatrix:
    """Attach a colour per category; one text stands for a palette of one."""
    held = getattr(lm, f"{axis}_categories")
    colors = [colors] if isinstance(colors, str) else list(colors)
    palette = small_table(lm.spark, list(enumerate(colors)), "code int, color string")
    old = held[column]
    return lm.replace(**{f"{axis}_categories": {**held, column: dataclasses.replace(old, colors=palette)}})


def rename_categories(lm: LabeledMatrix, axis: str, column: str, categories: Sequence[str]) -> LabeledMatrix:
    """Rename categories by position, in the dictionary, the column and linked metadata."""
    if isinstance(categories, Mapping):
        raise ValueError("give the new categories as a list, not a mapping")
    held = getattr(lm, f"{axis}_categories")
    if column not in held:
        raise ValueError(f"{column!r} is not a categorical column of {axis}")
    new = list(categories)
    old = held[column]
    n = old.table.count()
    if n != len(new):
        raise ValueError(f"{len(new)} new categories given for {n}")
    given = small_table(lm.spark, list(enumerate(new)), "code int, _new string")
    pairs = old.table.join(F.broadcast(given), "code")  # the caller's list, one row per category
    table = lm.axis(axis)
    lookup = pairs.select(F.col("category").alias(column), "_new")
    renamed = table.join(lookup, column, "left").select(
        *[F.col("_new").alias(column) if c == column else F.col(c) for c in table.columns]
    )
    cats = Categories(pairs.select("code", F.col("_new").alias("category")), old.ordered, old.colors, n)
    uns = None if lm.uns is None else rename_linked_fields(lm.uns, column, pairs.select("category", "_new"))
    return lm.replace(**{axis: renamed, f"{axis}_categories": {**held, column: cats}, "uns": uns})


def rename_linked_fields(uns: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Rename record fields in metadata grouped by ``column``.

    Applies below every top-level key ``k`` whose ``k / params / groupby`` is
    ``column``; a record ``k / r / field`` is renamed only if its fields are
    exactly the old categories.
    """
    marker = F.array(F.col("path")[0], F.lit("params"), F.lit("groupby"))
    linked = uns.where((F.size("path") == 3) & (F.col("path") == marker) & (F.col("value") == json.dumps(column)))
    linked = linked.select(F.col("path")[0].alias("k"))
    fields = uns.where((F.size("path") == 3) & (F.col("path")[1] != "params")).select(
        F.col("path")[0].alias("k"), F.col("path")[1].alias("rec"), F.col("path")[2].alias("category")
    )
    known = pairs.select("category", F.lit(1).alias("hit"))
    n_old = pairs.agg(F.count(F.lit(1)).alias("n_old"))
    records = (
        fields.join(linked, "k", "left_semi")
        .join(known, "category", "left")
        .groupBy("k", "rec")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
        .where("n = hits")
        .join(F.broadcast(n_old), F.col("n") == F.col("n_old"))  # a single row
        .select("k", "rec", F.lit(True).alias("rename"))
    )
    shaped = uns.select(
        "*", F.try_element_at("path", F.lit(1)).alias("k"), F.try_element_at("path", F.lit(2)).alias("rec"),
        F.when(F.size("path") == 3, F.col("path")[2]).alias("category"),
    )
    out = shaped.join(records, ["k", "rec"], "left").join(pairs, "category", "left")
    path = F.when(F.col("rename") & F.col("_new").isNotNull(), F.array("k", "rec", "_new")).otherwise(F.col("path"))
    return out.select(path.alias("path"), "value")
