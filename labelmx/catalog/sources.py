"""Storage queries: data derived from the tables is written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Graph, Vectors
from ..operators import nested
from ..operators.reshape import pack_dense
from ..plans.durable import new_path
from ..plans.local import small_table
from ..plans.ranks import ranked
from ..sources import bundle as B
from ..sources import text as T
from ..sources.csv_dir import write_csvs as write_dir
from .registry import query
from .tables import customers_by_brand, named_cells, orders_by_part, table, users_by_event

_CUST = """-- uses: cust
SELECT c_name AS obs_name, var_name, CAST(value AS DOUBLE) AS value FROM cust JOIN customer ON obs_key = c_custkey"""


def _stored(spark, lm, **options):
    path = new_path(spark, "bundle")
    B.write_bundle(lm, path, **options)
    return path


@query("write_bundle", """SELECT c_name AS name, c_mktsegment, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer""")
def write_bundle(spark, sf):
    """A stored axis table with its order."""
    return B.read_bundle(spark, _stored(spark, customers_by_brand(spark, sf))).obs.select("name", "c_mktsegment", "c_nationkey", "ord")


@query("read_bundle", """-- uses: cust, trade
SELECT 'X' AS slot, count(*) AS n, sum(value) AS total FROM cust UNION ALL SELECT 'lines', count(*), sum(lines) FROM cust
UNION ALL SELECT 'trade', count(*), sum(value) FROM trade UNION ALL SELECT 'money', count(*), round(sum(c_acctbal), 2) FROM customer
UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment), 0 FROM customer UNION ALL SELECT 'uns', 1, 25 FROM region WHERE r_regionkey = 0""")
def read_bundle(spark, sf):
    """Every element of a stored matrix."""
    lm = customers_by_brand(spark, sf, graph=True)
    money = Vectors(lm.obs.select("key", F.array("c_acctbal").alias("vec")), 1)
    lm = lm.replace(obsm={"money": money}, uns=nested.from_dict(spark, {"about": {"brands": 25}}))
    got = B.read_bundle(spark, _stored(spark, lm))
    total = lambda df, k, v: df.agg(F.lit(k).alias("slot"), F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 2).cast("double").alias("total"))
    out = total(got.X.cells, "X", "value").unionByName(total(got.layers["lines"].cells, "lines", "value"))
    out = out.unionByName(total(got.obsp["trade"].edges, "trade", "value"))
    out = out.unionByName(total(got.obsm["money"].rows, "money", F.col("vec")[0]))
    out = out.unionByName(total(got.obs_categories["c_mktsegment"].table, "segments", F.lit(0.0)))
    return out.unionByName(total(got.uns, "uns", F.col("value").cast("double")))


@query("open_lazy", """-- uses: ord
SELECT obs_key, var_key, value FROM ord WHERE obs_key BETWEEN 100 AND 900""")
def open_lazy(spark, sf):
    """A key range of a stored matrix; only its row groups are read."""
    path = _stored(spark, orders_by_part(spark, sf))
    return B.read_bundle(spark, path).X.cells.where(F.col("obs_key").between(100, 900))


@query("write_dense", """-- uses: wide
SELECT obs_name, var_name, value FROM wide""")
def write_dense(spark, sf):
    """Every cell written out."""
    return named_cells(B.read_bundle(spark, _stored(spark, customers_by_brand(spark, sf), as_dense=["X"])))


@query("write_compressed", _CUST)
def write_compressed(spark, sf):
    """Stored with another codec."""
    return named_cells(B.read_bundle(spark, _stored(spark, customers_by_brand(spark, sf), compression="gzip", compression_level=5)))


@query("write_blocked", """-- uses: ord, opos, ppos
SELECT CAST(opos.pos // 5000 AS BIGINT) AS row_block, CAST(ppos.pos // 1000 AS BIGINT) AS col_block, count(*) AS n, sum(value) AS total
FROM ord JOIN opos ON obs_key = o_orderkey JOIN ppos ON var_key = p_partkey GROUP BY 1, 2""")
def write_blocked(spark, sf):
    """Cells stored in blocks of 5000 × 1000."""
    lm = orders_by_part(spark, sf).replace(layers={})
    path = _stored(spark, lm, chunks=(5000, 1000))
    entry = B.read_manifest(spark, path)["slots"]["X"]
    cells = spark.read.parquet(f"{path}/{entry['segments'][0]}")
    key = [F.col("row_block").cast("bigint").alias("row_block"), F.col("col_block").cast("bigint").alias("col_block")]
    return cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("write_csvs", """SELECT 'obs' AS file, c_name AS name, CAST(c_acctbal AS VARCHAR) AS value FROM customer
UNION ALL SELECT 'obsm', NULL, CAST(c_acctbal AS VARCHAR) FROM customer""")
def write_csvs(spark, sf):
    """Text files of the annotation and the flattened vectors."""
    lm = customers_by_brand(spark, sf)
    lm = lm.replace(obsm={"money": Vectors(lm.obs.select("key", F.array("c_acctbal").alias("vec")), 1)})
    path = new_path(spark, "csvs")
    write_dir(lm, path, skip_data=False)
    obs = spark.read.csv(f"{path}/obs.csv", header=True).select(F.lit("obs").alias("file"), "name", F.col("c_acctbal").alias("value"))
    vec = spark.read.csv(f"{path}/obsm.csv", header=True).select(F.lit("obsm").alias("file"), F.lit(None).cast("string").alias("name"), F.col("money1").alias("value"))
    return obs.unionByName(vec)


def _text_of(lm, sep: str, *, header: str | None, names: bool):
    """``(at, value)`` lines of a dense matrix."""
    rows = pack_dense(lm).join(lm.obs.select(F.col("key").alias("obs_key"), F.col("ord").alias("at"), "name"), "obs_key")
    numbers = F.array_join(F.transform("values", lambda v: v.cast("string")), sep)
    lines = rows.select("at", (F.concat_ws(sep, "name", numbers) if names else numbers).alias("value"))
    if header is None:
        return lines
    return small_table(lm.spark, [(-1, header)], "at bigint, value string").unionByName(lines)


def _write_lines(lines, stem: str, *order: str, **options) -> str:
    """Write ``value`` along ``at``; lines that share it are dealt by ``order``, or one task would sort them all."""
    path = new_path(lines.sparkSession, stem)
    lines.orderBy("at", *order).select("value").write.options(**options).text(path)
    return path


@query("read_csv", """-- uses: wide
SELECT obs_name, var_name, value FROM wide""")
def read_csv(spark, sf):
    """A delimited matrix with a header and row names."""
    lm = customers_by_brand(spark, sf)
    brands = [r.name for r in lm.var.orderBy("ord").select("name").collect()]
    path = _write_lines(_text_of(lm, ",", header=",".join(["", *brands]), names=True), "csv")
    return named_cells(T.read_csv(spark, path, dtype="double"))


@query("read_text", """-- uses: wide
SELECT CAST(r AS VARCHAR) AS obs_name, CAST(var_pos AS VARCHAR) AS var_name, value FROM
(SELECT *, dense_rank() OVER (ORDER BY obs_key) - 1 AS r FROM wide)""")
def read_text(spark, sf):
    """Numbers separated by white space, with neither header nor names."""
    return named_cells(T.read_text(spark, _write_lines(_text_of(customers_by_brand(spark, sf), "  ", header=None, names=False), "txt"), dtype="double"))


@query("read_text_compressed", """-- uses: wide
SELECT obs_name, var_name, value FROM wide""")
def read_text_compressed(spark, sf):
    """A compressed tab-separated matrix whose last comment names the columns."""
    lm = customers_by_brand(spark, sf)
    brands = [r.name for r in lm.var.orderBy("ord").select("name").collect()]
    lines = _text_of(lm, "\t", header="# " + " ".join(brands), names=True)
    return named_cells(T.read_text(spark, _write_lines(lines, "gz", compression="gzip"), "\t", dtype="double"))


@query("read_umi_counts", """SELECT CAST(l_orderkey AS VARCHAR) AS obs_name, CAST(l_partkey AS VARCHAR) AS var_name, CAST(max_by(l_quantity, l_linenumber * 1000 + l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def read_umi_counts(spark, sf):
    """A gzipped gene / cell / count table in which the last repeated pair counts."""
    lines = table(spark, sf, "lineitem")
    at = (F.col("l_orderkey") * 1000 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("bigint")
    text = lines.select(at.alias("at"), F.concat_ws("\t", "l_partkey", "l_orderkey", F.col("l_quantity").cast("bigint")).alias("value"))
    text = small_table(spark, [(-1, "gene\tcell\tcount")], "at bigint, value string").unionByName(text)
    return named_cells(T.read_umi_counts(spark, _write_lines(text, "umi", compression="gzip"), dtype="double"))


@query("read_mtx", """-- uses: ord, opos, ppos
SELECT CAST(opos.pos AS VARCHAR) AS obs_name, CAST(ppos.pos AS VARCHAR) AS var_name, value FROM ord JOIN opos ON obs_key = o_orderkey JOIN ppos ON var_key = p_partkey""")
def read_mtx(spark, sf):
    """A coordinate matrix file."""
    lm = orders_by_part(spark, sf)
    place = lambda axis: lm.positions(axis).select(F.col("key").alias(f"{axis}_key"), F.col("pos").alias(f"{axis}_pos"))
    cells = lm.X.cells.join(place("obs"), "obs_key").join(place("var"), "var_key")
    n_obs, n_vars = lm.shape
    body = cells.select(F.lit(1).cast("bigint").alias("at"), F.concat_ws(" ", F.col("obs_pos") + 1, F.col("var_pos") + 1, "value").alias("value"), "obs_pos", "var_pos")
    head = [(-2, "%%MatrixMarket matrix coordinate real general"), (-1, "% orders by parts"), (0, f"{n_obs} {n_vars} {cells.count()}")]
    lines = small_table(spark, head, "at bigint, value string").unionByName(body, allowMissingColumns=True)
    path = _write_lines(lines, "mtx", "obs_pos", "var_pos")
    return named_cells(T.read_mtx(spark, path, dtype="double"))


@query("append", """-- uses: ord
SELECT obs_key, o_orderpriority, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey""")
def append(spark, sf):
    """A stored matrix of one status grown by the others; all cells must be there once."""
    lm = orders_by_part(spark, sf).replace(layers={})
    piece = lambda s: lm.subset(obs=F.col("o_orderstatus") == s)
    path = _stored(spark, piece("F"))
    for s in ("O", "P"):
        B.append(spark, path, piece(s))
    got = B.read_bundle(spark, path)
    obs = got.obs.select(F.col("key").alias("k"), F.col("name").cast("bigint").alias("obs_key"), "o_orderpriority")
    return got.X.cells.withColumnRenamed("obs_key", "k").join(obs, "k").select("obs_key", "o_orderpriority", "var_key", "value")


@query("append_var", """-- uses: ord
SELECT obs_key, var_key, value FROM ord""")
def append_var(spark, sf):
    """A column-clustered matrix grown by variables."""
    lm = orders_by_part(spark, sf).replace(layers={})
    path = _stored(spark, lm.subset(var=F.col("p_size") <= 25), layout="cols")
    B.append(spark, path, lm.subset(var=F.col("p_size") > 25), axis="var")
    got = B.read_bundle(spark, path)
    var = got.var.select(F.col("key").alias("k"), F.col("name").cast("bigint").alias("var_key"))
    return got.X.cells.withColumnRenamed("var_key", "k").join(var, "k").select("obs_key", "var_key", "value")
