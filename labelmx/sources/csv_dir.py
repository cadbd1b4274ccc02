"""A labeled matrix as a directory of delimited text files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, LabeledMatrix
from ..operators.build import flatten_vectors
from ..operators.reshape import pack_dense


def x_lines(lm: LabeledMatrix, sep: str = ",") -> DataFrame:
    """``(ord, value)``: one delimited line of dense values per observation."""
    blocks = pack_dense(lm).select("obs_key", F.struct("block", "values").alias("b"))
    rows = blocks.groupBy("obs_key").agg(F.sort_array(F.collect_list("b")).alias("b"))
    text = F.array_join(F.transform(F.flatten(F.col("b.values")), lambda v: v.cast("string")), sep)
    return lm.obs.select(F.col("key").alias("obs_key"), "ord").join(rows.select("obs_key", text.alias("value")), "obs_key").drop("obs_key")


def write_csvs(lm: LabeledMatrix, path: str, *, skip_data: bool = True, sep: str = ",", graphs_in_uns: dict[str, Graph] | None = None) -> None:
    """Write ``obs``, ``var``, ``obsm``, ``varm``, each ``uns`` entry and optionally ``X``.

    Every file is a Spark output directory whose part files are in axis order.
    Sparse entries among the metadata are left out with one warning.
    """
    path = path[:-4] if path.endswith(".csv") else path

    def put(df: DataFrame, name: str, header: bool = True) -> None:
        df.write.mode("overwrite").csv(f"{path}/{name}.csv", sep=sep, header=header)

    for axis in ("obs", "var"):
        table = lm.axis(axis)
        put(table.orderBy("ord").drop("key", "ord"), axis)
        if getattr(lm, f"{axis}m"):
            put(_vectors_in_order(lm, axis), f"{axis}m")
    if not skip_data:
        x_lines(lm, sep).orderBy("ord").select("value").write.mode("overwrite").text(f"{path}/X.csv")
    for at, el in lm.uns_tables.items():
        if isinstance(el, Graph):
            graphs_in_uns = {**(graphs_in_uns or {}), "/".join(at): el}
        else:
            put(el.rows.orderBy("key").drop("key"), "/".join(("uns", *at)))
    if graphs_in_uns:
        warnings.warn("sparse metadata entries are not written", UserWarning, stacklevel=2)
    if lm.uns is not None:
        top = [r[0] for r in lm.uns.select(F.col("path")[0]).distinct().collect()]
        for k in top:
            leaves = lm.uns.where(F.col("path")[0] == k)
            put(leaves.select(F.array_join(F.slice("path", F.lit(2), F.size("path")), "/").alias("path"), "value"), f"uns/{k}", header=False)


def _vectors_in_order(lm: LabeledMatrix, axis: str) -> DataFrame:
    """Flattened vectors in axis order, without names."""
    table = lm.axis(axis)
    keyed = lm.replace(**{axis: table.select("key", "ord", F.col("ord").cast("string").alias("name"))})
    flat = flatten_vectors(keyed, axis).withColumn("ord", F.col("name").cast("bigint"))
    return flat.orderBy("ord").drop("name", "ord")
