"""Labeled matrices built from the given tables.

Cells come from the tables that the axes are made of, so keys are not checked again here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import Graph, LabeledMatrix, Matrix, Vectors, axis_table
from ..operators.build import create


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per path."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def orders_by_part(spark: SparkSession, sf: str) -> LabeledMatrix:
    """Orders × parts: quantity, with price and line-count layers."""
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("obs_key"), F.col("l_partkey").alias("var_key")).agg(
        F.sum("l_quantity").alias("value"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    layer = lambda c: cells.select("obs_key", "var_key", F.col(c).alias("value"))
    return create(
        layer("value"), axis_table(table(spark, sf, "orders"), key="o_orderkey"), axis_table(table(spark, sf, "part"), key="p_partkey"),
        layers={"price": layer("price"), "lines": layer("lines")}, dtype=None, check=False,
    )


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with customer and part columns."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name")
    return lines.join(orders, "l_orderkey").join(parts, "l_partkey")


def brand_axis(spark: SparkSession, sf: str) -> DataFrame:
    return axis_table(table(spark, sf, "part").select("p_brand").distinct(), name="p_brand", order="p_brand")


def customers_by_brand(spark: SparkSession, sf: str, *, graph: bool = False) -> LabeledMatrix:
    """Customers × brands: quantity and line-count layer; optionally the trade graph."""
    bought = purchases(spark, sf).groupBy(F.col("o_custkey").alias("obs_key"), F.col("p_brand").alias("var_name")).agg(
        F.sum("l_quantity").alias("value"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    lm = create(
        bought.select("obs_key", "var_name", "value"),
        axis_table(table(spark, sf, "customer"), key="c_custkey", name="c_name"), brand_axis(spark, sf),
        layers={"lines": bought.select("obs_key", "var_name", F.col("lines").alias("value"))}, dtype=None, check=False,
    ).replace(var_dense=True)
    return lm.replace(obsp={"trade": trade_graph(spark, sf)}) if graph else lm


def trade_graph(spark: SparkSession, sf: str) -> Graph:
    """Who buys from whom, on the customer axis: supplier numbers are customer numbers too."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = lines.join(orders, "l_orderkey").groupBy(F.col("o_custkey").alias("i_key"), F.col("l_suppkey").alias("j_key"))
    return Graph(edges.agg(F.sum("l_quantity").alias("value")))


def users_by_event(spark: SparkSession, sf: str) -> LabeledMatrix:
    """Users × event types: summed value, with a count layer."""
    events = table(spark, sf, "events")
    cells = events.groupBy(F.col("user_id").alias("obs_key"), F.col("event_type").alias("var_name")).agg(
        F.round(F.sum("value"), 4).alias("value"), F.count(F.lit(1)).cast("double").alias("n")
    )
    return create(
        cells.select("obs_key", "var_name", "value"),
        axis_table(events.select("user_id").distinct(), key="user_id"),
        axis_table(events.select("event_type").distinct(), name="event_type", order="event_type"),
        layers={"n": cells.select("obs_key", "var_name", F.col("n").alias("value"))}, dtype=None, check=False,
    )


def embedded(spark: SparkSession, sf: str) -> LabeledMatrix:
    """Embeddings as a 64-wide vector element; the label is annotation."""
    e = table(spark, sf, "embeddings")
    vec = e.select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    obs = axis_table(e.select("vec_id", "label"), key="vec_id")
    var = axis_table(e.select("label").distinct(), key="label")
    return LabeledMatrix(obs, var, obsm={"X_emb": Vectors(vec, 64)})


def documents_by_lang(spark: SparkSession, sf: str) -> LabeledMatrix:
    """Documents × languages, 1 where the language matches; labels are nullable annotation."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    obs = axis_table(docs.join(table(spark, sf, "labels"), "doc_id", "left"), key="doc_id")
    var = axis_table(docs.select("lang").distinct(), name="lang", order="lang")
    cells = docs.select(F.col("doc_id").alias("obs_key"), F.col("lang").alias("var_name"), F.lit(1.0).alias("value"))
    return create(cells, obs, var, dtype=None, check=False)


SEGMENTS = (("BUILDING", "HOUSEHOLD"), ("MACHINERY",), None)
LEFT_OUT = ("small ", "red ", None)


def shops(spark: SparkSession, sf: str, *, graph: bool = False) -> list[LabeledMatrix]:
    """Three customers × part-names matrices whose variables overlap but differ."""
    named = [s for seg in SEGMENTS if seg for s in seg]
    bought = purchases(spark, sf).groupBy(F.col("o_custkey").alias("obs_key"), F.col("p_name").alias("var_name")).agg(
        F.sum("l_quantity").alias("value"), F.count(F.lit(1)).cast("double").alias("lines")
    )
    part, customer = table(spark, sf, "part"), table(spark, sf, "customer")
    trade = trade_graph(spark, sf).edges if graph else None
    out = []
    for i, (segment, colour) in enumerate(zip(SEGMENTS, LEFT_OUT)):
        mine = F.col("c_mktsegment").isin(*segment) if segment else ~F.col("c_mktsegment").isin(*named)
        people = customer.where(mine)
        if i == 2:
            people = people.withColumnRenamed("c_nationkey", "nation")
        obs = axis_table(people, key="c_custkey", name="c_name")
        parts = part if colour is None else part.where(~F.col("p_name").startswith(colour))
        kinds = parts.groupBy("p_name").agg(F.count(F.lit(1)).alias("n_parts"), F.max("p_size").alias("max_size"))
        kinds = kinds.withColumn("shop", F.lit(i).cast("bigint"))
        if i == 2:
            kinds = kinds.withColumn("last", F.col("n_parts") + 1)
        var = axis_table(kinds, name="p_name", order="p_name")
        members = obs.select(F.col("key").alias("obs_key"))
        # names that this shop leaves out have no variable, so their purchases stay out too
        cells = bought.join(members, "obs_key", "left_semi").join(kinds.select(F.col("p_name").alias("var_name")), "var_name", "left_semi")
        layers = {"lines": cells.select("obs_key", "var_name", F.col("lines").alias("value"))} if i < 2 else {}
        lm = create(cells.select("obs_key", "var_name", "value"), obs, var, layers=layers, dtype=None, check=False).replace(var_dense=True)
        if graph:
            keys = lambda c: members.withColumnRenamed("obs_key", c)
            mine = trade.join(keys("i_key"), "i_key", "left_semi").join(keys("j_key"), "j_key", "left_semi")
            lm = lm.replace(obsp={"trade": Graph(mine)})
        out.append(lm)
    return out


def named_cells(lm: LabeledMatrix, m: Matrix | None = None) -> DataFrame:
    """Cells with axis names: ``(obs_name, var_name, value)``."""
    m = m or lm.X
    obs = lm.obs.select(F.col("key").alias("obs_key"), F.col("name").alias("obs_name"))
    var = lm.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return m.cells.join(obs, "obs_key").join(var, "var_key").select("obs_name", "var_name", "value")
