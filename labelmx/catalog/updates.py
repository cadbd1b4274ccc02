"""Update queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Matrix
from ..operators import update as U
from ..operators.reshape import densify
from ..plans.ranks import ranked
from .registry import query
from .tables import customers_by_brand, named_cells, orders_by_part, table


@query("set_matrix", """-- uses: ord
SELECT obs_key, var_key, lines AS value FROM ord""")
def set_matrix(spark, sf):
    """X replaced by a layer of the same shape."""
    lm = orders_by_part(spark, sf)
    return U.set_matrix(lm, lm.layers["lines"]).X.cells


@query("set_matrix_scalar", """-- uses: brands
SELECT c_name AS obs_name, b.name AS var_name, 2.5::DOUBLE AS value FROM customer CROSS JOIN brands b""")
def set_matrix_scalar(spark, sf):
    """X replaced by one value in every cell."""
    return named_cells(U.set_matrix(customers_by_brand(spark, sf), 2.5))


@query("assign_block", """-- uses: cust
SELECT c_name AS obs_name, var_name, CAST(value AS DOUBLE) AS value FROM cust JOIN customer ON obs_key = c_custkey
WHERE NOT (c_mktsegment = 'BUILDING' AND var_name IN (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#2'))
UNION ALL SELECT c_name, p_brand, -1.0::DOUBLE FROM customer, (SELECT DISTINCT p_brand FROM part WHERE p_brand < 'Brand#2') WHERE c_mktsegment = 'BUILDING'""")
def assign_block(spark, sf):
    """A scalar written to the block of two selections."""
    lm = customers_by_brand(spark, sf)
    return named_cells(U.assign_block(lm, F.col("c_mktsegment") == "BUILDING", F.col("name") < "Brand#2", -1.0))


@query("assign_cells", """-- uses: ord
WITH new AS (SELECT l_orderkey AS obs_key, l_suppkey AS var_key, max(l_extendedprice) AS nv FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2)
SELECT obs_key, var_key, coalesce(nv, value) AS value FROM ord FULL JOIN new USING (obs_key, var_key)""")
def assign_cells(spark, sf):
    """Single cells written, some stored and most new."""
    lines = table(spark, sf, "lineitem")
    new = lines.groupBy(F.col("l_orderkey").alias("obs_key"), F.col("l_suppkey").alias("var_key")).agg(F.max("l_extendedprice").alias("value"))
    new = new.join(table(spark, sf, "part").select(F.col("p_partkey").alias("var_key")), "var_key", "left_semi")
    return U.assign_cells(orders_by_part(spark, sf), new).X.cells


@query("update_existing_only", """-- uses: ord
WITH new AS (SELECT l_orderkey AS obs_key, l_partkey AS var_key, max(l_extendedprice) AS nv FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT obs_key, var_key, coalesce(nv, value) AS value FROM ord LEFT JOIN new USING (obs_key, var_key)""")
def update_existing_only(spark, sf):
    """Returned lines' cells overwritten; all of them are stored."""
    back = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    new = back.groupBy(F.col("l_orderkey").alias("obs_key"), F.col("l_partkey").alias("var_key")).agg(F.max("l_extendedprice").alias("value"))
    return U.update_existing_only(orders_by_part(spark, sf), new).X.cells


@query("set_element", """-- uses: ord
SELECT obs_key, var_key, value / lines AS value FROM ord""")
def set_element(spark, sf):
    """A new layer, checked against the axes and then stored."""
    lm = orders_by_part(spark, sf)
    both = lm.X.cells.join(lm.layers["lines"].cells.withColumnRenamed("value", "lines"), ["obs_key", "var_key"])
    mean = Matrix(both.select("obs_key", "var_key", (F.col("value") / F.col("lines")).alias("value")))
    return U.set_element(lm, "layers", "mean", mean).layers["mean"].cells


@query("drop_element", """SELECT unnest(['lines']) AS layer, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS n""")
def drop_element(spark, sf):
    """Layers left after one was removed."""
    lm = U.drop_element(orders_by_part(spark, sf), "layers", "price")
    (name, m), = lm.layers.items()
    return m.cells.agg(F.lit(name).alias("layer"), F.count(F.lit(1)).alias("n"))


@query("copy_on_write", """-- uses: ord
SELECT 'parent' AS side, count(*) AS n, count(o_orderpriority) AS labels FROM orders
UNION ALL SELECT 'subset', count(*), 0 FROM orders WHERE o_orderstatus = 'F'""")
def copy_on_write(spark, sf):
    """A changed subset and its unchanged parent."""
    lm = orders_by_part(spark, sf)
    sub = U.set_column(lm.subset(obs=F.col("o_orderstatus") == "F"), "obs", "o_orderpriority", F.lit(None).cast("string"))
    count = lambda d, k: d.agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("labels"))
    return count(lm.obs, "parent").unionByName(count(sub.obs, "subset"))


@query("edit_annotation", """SELECT o_orderkey AS key, round(o_totalprice * 2, 2) AS double_price, o_orderstatus,
  coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS n_lines FROM orders""")
def edit_annotation(spark, sf):
    """Annotation columns added by expression and by key, and one dropped."""
    lm = orders_by_part(spark, sf)
    lm = U.set_column(lm, "obs", "double_price", F.round(F.col("o_totalprice") * 2, 2))
    per_order = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    counts = lm.obs.select("key").join(per_order, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("value"))
    lm = U.set_column(lm, "obs", "n_lines", counts)
    lm = U.drop_column(lm, "obs", "o_orderpriority")
    return lm.obs.select("key", "double_price", "o_orderstatus", "n_lines")


@query("replace_annotation", """WITH new AS (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS pos, 'o' || o_orderkey AS name, o_totalprice AS price FROM orders),
old AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT key, name, price FROM old JOIN new USING (pos)""")
def replace_annotation(spark, sf):
    """The whole annotation replaced by rows matched by position."""
    lm = orders_by_part(spark, sf)
    rows = table(spark, sf, "orders").select(
        F.concat(F.lpad((F.round((F.lit(1e9) - F.col("o_totalprice")) * 100)).cast("bigint").cast("string"), 14, "0"),
                 F.lpad((F.lit(10**15) - F.col("o_orderkey")).cast("string"), 18, "0")).alias("at"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_totalprice").alias("price"))
    return U.replace_annotation(lm, "obs", ranked(rows, "at", "pos").drop("at")).obs.select("key", "name", "price")


@query("snapshot_raw", """-- uses: ord
SELECT obs_key, var_key, value FROM ord""")
def snapshot_raw(spark, sf):
    """Raw keeps the values X had before it was changed."""
    lm = orders_by_part(spark, sf)
    lm = U.snapshot_raw(lm, lm)
    lm = lm.replace(X=Matrix(lm.X.cells.withColumn("value", F.col("value") * 0.5)))
    return lm.raw.X.cells


@query("materialize", """-- uses: ord
SELECT obs_key, o_orderstatus, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey""")
def materialize(spark, sf):
    """Every element computed once and read back."""
    lm = U.materialize(orders_by_part(spark, sf))
    return lm.X.cells.join(lm.obs.select(F.col("key").alias("obs_key"), "o_orderstatus"), "obs_key")


@query("checkpoint_matrix", """-- uses: ord
SELECT var_key, sum(value) AS total FROM ord GROUP BY 1""")
def checkpoint_matrix(spark, sf):
    """Lineage cut by a reliable checkpoint."""
    return U.checkpointed(orders_by_part(spark, sf).X).cells.groupBy("var_key").agg(F.sum("value").alias("total"))
