"""Value access queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as A
from ..operators.update import snapshot_raw
from .registry import query
from .tables import customers_by_brand, orders_by_part, table


def _vector(df):
    return df.select("name", "value")


@query("obs_vector", """-- uses: wide
SELECT obs_name AS name, value FROM wide WHERE var_name = 'Brand#7'""")
def obs_vector(spark, sf):
    """One brand's quantity for every customer, zeros filled."""
    return _vector(customers_by_brand(spark, sf).obs_vector("Brand#7"))


@query("obs_vector_layer", """-- uses: cust
SELECT c_name AS name, coalesce(lines, 0.0) AS value FROM customer LEFT JOIN cust ON obs_key = c_custkey AND var_name = 'Brand#7'""")
def obs_vector_layer(spark, sf):
    """The same from a layer."""
    return _vector(customers_by_brand(spark, sf).obs_vector("Brand#7", layer="lines"))


@query("obs_vector_column", "SELECT c_name AS name, c_mktsegment AS value FROM customer")
def obs_vector_column(spark, sf):
    """An annotation column by the same call."""
    return _vector(customers_by_brand(spark, sf).obs_vector("c_mktsegment"))


@query("var_vector", """-- uses: ord
SELECT CAST(p_partkey AS VARCHAR) AS name, coalesce(value, 0.0) AS value FROM part
LEFT JOIN ord ON var_key = p_partkey AND obs_key = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))""")
def var_vector(spark, sf):
    """The last order with lines as a vector over all parts."""
    last = table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0]
    return _vector(orders_by_part(spark, sf).var_vector(str(last)))


@query("raw_vector", """-- uses: wide
SELECT obs_name AS name, value FROM wide WHERE var_name = 'Brand#9'""")
def raw_vector(spark, sf):
    """A vector from raw of a variable X no longer has."""
    lm = customers_by_brand(spark, sf)
    lm = snapshot_raw(lm.subset(var="Brand#7"), lm)
    return _vector(A.raw_vector(lm, "obs", "Brand#9"))


@query("pick_matrix", """-- uses: ord
SELECT 'X' AS source, count(*) AS n, sum(value) AS total FROM ord JOIN part ON var_key = p_partkey WHERE p_size > 40
UNION ALL SELECT 'layer', count(*), sum(lines) FROM ord JOIN part ON var_key = p_partkey WHERE p_size > 40
UNION ALL SELECT 'raw', count(*), sum(value) FROM ord""")
def pick_matrix(spark, sf):
    """X, a layer and raw of one object."""
    lm = orders_by_part(spark, sf)
    lm = snapshot_raw(lm.subset(var=F.col("p_size") > 40), lm)
    total = lambda m, k: m.cells.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit(k).alias("source"), "n", "total")
    return (
        total(A.pick_matrix(lm), "X").unionByName(total(A.pick_matrix(lm, layer="lines"), "layer"))
        .unionByName(total(A.pick_matrix(lm, use_raw=True), "raw"))
    )


@query("to_wide", """-- uses: wide
PIVOT (SELECT obs_name AS name, var_name, value FROM wide) ON var_name IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7',
 'Brand#8', 'Brand#9', 'Brand#10', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#16', 'Brand#17', 'Brand#18', 'Brand#19', 'Brand#20',
 'Brand#21', 'Brand#22', 'Brand#23', 'Brand#24', 'Brand#25') USING max(value) GROUP BY name""")
def to_wide(spark, sf):
    """Customers by brands as a wide table."""
    return customers_by_brand(spark, sf).to_wide()


@query("to_wide_columns", """-- uses: wide
PIVOT (SELECT obs_name AS name, var_name, value FROM wide) ON var_name IN ('Brand#7', 'Brand#21', 'Brand#3') USING max(value) GROUP BY name""")
def to_wide_columns(spark, sf):
    """Three brands in the caller's order; no name is collected."""
    return customers_by_brand(spark, sf).to_wide(columns=["Brand#7", "Brand#21", "Brand#3"], width=2)
