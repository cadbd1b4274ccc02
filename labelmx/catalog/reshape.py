"""Reshape, chunk and sample queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import SparseVectors
from ..operators import reshape as R
from ..operators.build import assemble_vectors, flatten_vectors
from .registry import query
from .tables import customers_by_brand, embedded, named_cells, orders_by_part, table

# the sampling rule in SQL: first 15 hex digits of an md5
_HEX = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@query("transpose", """-- uses: ord
SELECT var_key AS obs_key, obs_key AS var_key, value FROM ord""")
def transpose(spark, sf):
    """Parts × orders."""
    return orders_by_part(spark, sf).T.X.cells


@query("pack_rows", """-- uses: ord, ppos
SELECT obs_key AS key, CAST(pos // 512 AS BIGINT) AS block, count(*) AS n, sum(value * (pos % 512)) AS checksum, max(pos % 512) AS last
FROM ord JOIN ppos ON var_key = p_partkey GROUP BY 1, 2""")
def pack_rows(spark, sf):
    """Compressed rows in column blocks of 512."""
    p = R.pack_rows(orders_by_part(spark, sf), width=512)
    total = F.aggregate("packed", F.lit(0.0), lambda acc, x: acc + x["value"] * x["off"])
    return p.select("key", "block", F.size("packed").cast("bigint").alias("n"), total.alias("checksum"),
                    F.element_at("packed", -1)["off"].cast("bigint").alias("last"))


@query("pack_cols", """-- uses: ord, opos
SELECT var_key AS key, CAST(pos // 4096 AS BIGINT) AS block, count(*) AS n, sum(value) AS total
FROM ord JOIN opos ON obs_key = o_orderkey GROUP BY 1, 2""")
def pack_cols(spark, sf):
    """Compressed columns in row blocks of 4096."""
    p = R.pack_cols(orders_by_part(spark, sf))
    total = F.aggregate("packed", F.lit(0.0), lambda acc, x: acc + x["value"])
    return p.select("key", "block", F.size("packed").cast("bigint").alias("n"), total.alias("total"))


@query("unpack", """-- uses: ord
SELECT obs_key, var_key, value FROM ord""")
def unpack(spark, sf):
    """Compressed rows back to cells."""
    lm = orders_by_part(spark, sf)
    return R.unpack(lm, R.pack_rows(lm, width=512), width=512).cells


@query("densify", """-- uses: wide
SELECT obs_name, var_name, value FROM wide""")
def densify(spark, sf):
    """Every customer × brand cell."""
    lm = customers_by_brand(spark, sf)
    return named_cells(lm, R.densify(lm))


@query("sparsify", """-- uses: wide
SELECT obs_name, var_name, value FROM wide WHERE value <> 0""")
def sparsify(spark, sf):
    """Dense cells without their zeros."""
    lm = customers_by_brand(spark, sf)
    return named_cells(lm, R.sparsify(R.densify(lm), lm))


@query("read_as_sparse", """-- uses: cust
SELECT c_name AS obs_name, var_name, lines AS value FROM cust JOIN customer ON obs_key = c_custkey""")
def read_as_sparse(spark, sf):
    """A densely stored X read as sparse."""
    from ..plans.durable import new_path
    from ..sources.bundle import read_bundle, write_bundle
    lm = customers_by_brand(spark, sf)
    lm = lm.replace(X=lm.layers["lines"], layers={})
    path = new_path(spark, "dense")
    write_bundle(lm, path, as_dense=["X"])
    return named_cells(R.read_as_sparse(read_bundle(spark, path)))


@query("map_chunks", """-- uses: wide
SELECT CAST(r // 600 * 600 AS BIGINT) AS start, CAST(max(r) + 1 AS BIGINT) AS "end", CAST(25 AS BIGINT) AS width, sum(value * (r % 7)) AS total
FROM (SELECT *, dense_rank() OVER (ORDER BY obs_key) - 1 AS r FROM wide) GROUP BY r // 600""")
def map_chunks(spark, sf):
    """A user function over chunks of 600 dense rows."""

    def chunk_sums(values, start, end, var_start):
        # nested, so that it reaches the executors by value
        import numpy as np
        import pandas as pd
        rows = np.arange(start, end).reshape(-1, 1)
        return pd.DataFrame({"start": [start], "end": [end], "width": [values.shape[1]], "total": [float((values * (rows % 7)).sum())]})

    return R.map_chunks(customers_by_brand(spark, sf), chunk_sums, "start bigint, end bigint, width bigint, total double", chunk_size=600)


@query("sample_rows", f"""-- uses: wide
WITH draws AS (SELECT i, {_HEX.format("i || ':7'")} % (SELECT count(*) FROM customer) AS pos FROM range(least(1000, (SELECT count(*) FROM customer))) t(i)),
p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT i AS row, var_name, value FROM draws JOIN p USING (pos) JOIN wide ON obs_key = c_custkey""")
def sample_rows(spark, sf):
    """1000 random customers with replacement, dense."""
    lm = R.sample_rows(customers_by_brand(spark, sf), 1000, seed=7)
    var = lm.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return lm.X.cells.join(var, "var_key").select(F.col("obs_key").alias("row"), "var_name", "value")


@query("sample_rows_distinct", f"""-- uses: wide
WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey || ':3'), CAST(c_custkey AS VARCHAR)) - 1 AS row FROM customer)
SELECT row, var_name, value FROM s JOIN wide ON obs_key = c_custkey WHERE row < 400""")
def sample_rows_distinct(spark, sf):
    """400 random customers without replacement, dense."""
    lm = R.sample_rows(customers_by_brand(spark, sf), 400, replace=False, seed=3)
    var = lm.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return lm.X.cells.join(var, "var_key").select(F.col("obs_key").alias("row"), "var_name", "value")


@query("take_rows", """-- uses: wide
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer),
w AS (SELECT s_suppkey * 2 AS row, s_suppkey AS pos FROM supplier UNION ALL SELECT s_suppkey * 2 + 1, s_suppkey FROM supplier)
SELECT row, var_name, value FROM w JOIN p USING (pos) JOIN wide ON obs_key = c_custkey""")
def take_rows(spark, sf):
    """Customers at the suppliers' positions, each twice, dense."""
    s = table(spark, sf, "supplier")
    picked = s.select(F.col("s_suppkey").alias("pos"), F.explode(F.array(F.col("s_suppkey") * 2, F.col("s_suppkey") * 2 + 1)).alias("new_key"))
    lm = R.take_rows(customers_by_brand(spark, sf), picked)
    var = lm.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return lm.X.cells.join(var, "var_key").select(F.col("obs_key").alias("row"), "var_name", "value")


@query("block_grid", """-- uses: opos
SELECT o_orderkey AS key, CAST(pos // 4000 AS BIGINT) AS block, CAST(pos // 4000 * 4000 AS BIGINT) AS start, least(pos // 4000 * 4000 + 4000, (SELECT count(*) FROM orders)) AS stop FROM opos""")
def block_grid(spark, sf):
    """Orders in contiguous blocks of 4000."""
    return R.block_grid(orders_by_part(spark, sf), axis="obs", size=4000).select("key", "block", "start", "stop")


@query("assemble_vectors", "SELECT c_custkey AS key, [CAST(c_nationkey AS DOUBLE), c_acctbal] AS vec FROM customer")
def assemble(spark, sf):
    """Two annotation columns stacked into one vector element."""
    return assemble_vectors(customers_by_brand(spark, sf), "obs", "money", ["c_nationkey", "c_acctbal"]).obsm["money"].rows


_FLAT = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS X_emb{i}" for i in range(1, 65))


@query("flatten_vectors", f"SELECT CAST(vec_id AS VARCHAR) AS name, {_FLAT} FROM embeddings")
def flatten(spark, sf):
    """A 64-wide vector element as 64 columns."""
    return flatten_vectors(embedded(spark, sf), "obs")


_SIZES = ", ".join(f"coalesce(sum(l_quantity) FILTER (p_size = {i}), 0)::DOUBLE AS size{i}" for i in range(1, 51))


@query("flatten_sparse_vectors", f"""SELECT c_name AS name, {_SIZES} FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY c_custkey, c_name""")
def flatten_sparse(spark, sf):
    """Entries by part size as 50 columns, 0 where there is none."""
    lm = customers_by_brand(spark, sf)
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    sizes = lines.groupBy(F.col("o_custkey").alias("key"), (F.col("p_size") - 1).cast("bigint").alias("index")).agg(F.sum("l_quantity").cast("double").alias("value"))
    return flatten_vectors(lm.replace(obsm={"size": SparseVectors(sizes, 50)}), "obs")
