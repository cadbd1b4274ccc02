"""Selection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Matrix
from ..operators import select as S
from ..operators.categories import dictionary, set_palette
from ..operators.update import snapshot_raw
from ..plans.ranks import ranked
from .registry import query
from .tables import customers_by_brand, documents_by_lang, orders_by_part, table


def keyed_cells(lm, m: Matrix | None = None) -> DataFrame:
    return (m or lm.X).cells.select("obs_key", "var_key", "value")


def _large_parts(spark, sf, order: str = "p_partkey", descending: bool = True) -> DataFrame:
    """Names of the parts of size 25 and more, largest key first."""
    big = table(spark, sf, "part").where("p_size >= 25").select(
        F.col("p_partkey").cast("string").alias("name"), (-F.col(order) if descending else F.col(order)).alias("at")
    )
    return ranked(big, "at", "new_key").select("name", "new_key")


@query("subset_labels", """-- uses: ord
WITH picked AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS new_key FROM part WHERE p_size >= 25)
SELECT obs_key, new_key AS var_key, value FROM ord JOIN picked ON var_key = p_partkey""")
def subset_labels(spark, sf):
    """Parts chosen by a list of names, in the order of the list."""
    return keyed_cells(orders_by_part(spark, sf).subset(var=_large_parts(spark, sf)))


@query("subset_label", """-- uses: wide
SELECT obs_name, var_name, value FROM wide WHERE var_name = (SELECT max(p_brand) FROM part) AND value <> 0""")
def subset_label(spark, sf):
    """One variable by name; the result keeps both dimensions."""
    name = table(spark, sf, "part").agg(F.max("p_brand")).first()[0]
    lm = customers_by_brand(spark, sf).subset(var=name)
    names = lm.obs.select(F.col("key").alias("obs_key"), F.col("name").alias("obs_name"))
    var = lm.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return lm.X.cells.join(names, "obs_key").join(var, "var_key").select("obs_name", "var_name", "value")


@query("subset_positions", """-- uses: ord, opos
WITH picked AS (SELECT c_custkey * 2 AS pos, 2 * c_custkey AS new_key FROM customer UNION ALL SELECT c_custkey * 2, 2 * c_custkey + 1 FROM customer)
SELECT new_key AS obs_key, var_key, value FROM ord JOIN opos ON obs_key = o_orderkey JOIN picked USING (pos)""")
def subset_positions(spark, sf):
    """Rows at a list of positions, every position twice."""
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    twice = people.select((F.col("k") * 2).alias("pos"), F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("new_key"))
    return keyed_cells(orders_by_part(spark, sf).subset(obs=twice))


@query("subset_position", """-- uses: ord, ppos
SELECT obs_key, var_key, value FROM ord WHERE var_key = (SELECT p_partkey FROM ppos WHERE pos = (SELECT count(*) - 1 FROM part))""")
def subset_position(spark, sf):
    """The last variable by position."""
    return keyed_cells(orders_by_part(spark, sf).subset(var=-1))


@query("subset_slice", """-- uses: ord, opos, ppos
SELECT obs_key, var_key, value FROM ord JOIN opos ON obs_key = o_orderkey JOIN ppos ON var_key = p_partkey
WHERE opos.pos % 2 = 0 AND ppos.pos >= 5""")
def subset_slice(spark, sf):
    """A stepped slice of rows and an open slice of columns."""
    return keyed_cells(orders_by_part(spark, sf)[::2, 5:])


@query("subset_label_slice", """-- uses: wide
SELECT obs_name, var_name, value FROM wide
WHERE var_pos BETWEEN (SELECT pos FROM brands WHERE name = 'Brand#11') AND (SELECT pos FROM brands WHERE name = 'Brand#20') AND value <> 0""")
def subset_label_slice(spark, sf):
    """Brands between two labels, the last one included."""
    from .tables import named_cells
    return named_cells(customers_by_brand(spark, sf)[:, "Brand#11":"Brand#20"])


@query("subset_mask", """-- uses: ord
SELECT obs_key, var_key, value FROM ord JOIN part ON var_key = p_partkey WHERE p_retailprice > 950""")
def subset_mask(spark, sf):
    """Variables kept by a boolean mask over the whole axis."""
    mask = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (F.col("p_retailprice") > 950).alias("keep"))
    return keyed_cells(orders_by_part(spark, sf).subset(var=mask))


@query("subset_where", """-- uses: ord
SELECT obs_key, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def subset_where(spark, sf):
    """Orders kept by a predicate on an annotation column."""
    return keyed_cells(orders_by_part(spark, sf).subset(obs=F.col("o_orderpriority") == "1-URGENT"))


@query("subset_by_value", """-- uses: wide
SELECT obs_name, var_name, value FROM wide WHERE value <> 0 AND obs_key IN (SELECT obs_key FROM wide WHERE var_name = 'Brand#1' AND value < 20)""")
def subset_by_value(spark, sf):
    """Customers whose quantity of one brand is small; customers without any count as 0."""
    from .tables import named_cells
    return named_cells(S.subset_by_value(customers_by_brand(spark, sf), "obs", "Brand#1", lambda v: v < 20))


@query("subset_both", """-- uses: ord
SELECT obs_key, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey JOIN part ON var_key = p_partkey
WHERE o_orderstatus = 'F' AND p_size > 25""")
def subset_both(spark, sf):
    """Selections on both axes combine as an outer product."""
    return keyed_cells(orders_by_part(spark, sf)[F.col("o_orderstatus") == "F", F.col("p_size") > 25])


@query("subset_chain", """-- uses: ord
WITH kept AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders WHERE o_orderstatus = 'F')
SELECT obs_key, var_key, value FROM ord JOIN kept ON obs_key = o_orderkey JOIN part ON var_key = p_partkey
WHERE pos >= 10 AND p_size > 25""")
def subset_chain(spark, sf):
    """A subset of a subset of a subset."""
    lm = orders_by_part(spark, sf)
    return keyed_cells(lm[F.col("o_orderstatus") == "F"][:, F.col("p_size") > 25][10:])


@query("propagate_subset", """-- uses: ord, cust, trade
WITH keep AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT 'X' AS slot, count(*) AS n, sum(value) AS total FROM cust WHERE obs_key IN (FROM keep)
UNION ALL SELECT 'lines', count(*), sum(lines) FROM cust WHERE obs_key IN (FROM keep)
UNION ALL SELECT 'trade', count(*), sum(value) FROM trade WHERE i IN (FROM keep) AND j IN (FROM keep)
UNION ALL SELECT 'obs', count(*), sum(CAST(c_nationkey AS DOUBLE)) FROM customer WHERE c_custkey IN (FROM keep)""")
def propagate_subset(spark, sf):
    """One selection followed by every element; a graph is cut on both sides."""
    lm = customers_by_brand(spark, sf, graph=True).subset(obs=F.col("c_acctbal") > 0)
    parts = {"X": lm.X.cells, "lines": lm.layers["lines"].cells, "trade": lm.obsp["trade"].edges,
             "obs": lm.obs.select(F.col("c_nationkey").cast("double").alias("value"))}
    rows = [d.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit(k).alias("slot"), "n", "total") for k, d in parts.items()]
    return reduce(DataFrame.unionByName, rows)


@query("subset_keeps_raw_vars", """-- uses: ord
SELECT 'X' AS slot, count(*) AS n, sum(value) AS total FROM ord JOIN orders ON obs_key = o_orderkey JOIN part ON var_key = p_partkey WHERE o_orderstatus = 'F' AND p_size > 25
UNION ALL SELECT 'raw', count(*), sum(value) FROM ord JOIN orders ON obs_key = o_orderkey WHERE o_orderstatus = 'F'""")
def subset_keeps_raw_vars(spark, sf):
    """Selecting variables leaves raw alone; selecting observations cuts it too."""
    lm = orders_by_part(spark, sf)
    lm = snapshot_raw(lm, lm)[F.col("o_orderstatus") == "F", F.col("p_size") > 25]
    total = lambda d, k: d.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.lit(k).alias("slot"), "n", "total")
    return total(lm.X.cells, "X").unionByName(total(lm.raw.X.cells, "raw"))


_COLOURS = [f"#{i:02x}{255 - i:02x}80" for i in range(4)]


def _with_lang(spark, sf, colours):
    lm = documents_by_lang(spark, sf)
    lm = lm.replace(obs_categories={"lang": dictionary(lm.obs, "lang")})
    return set_palette(lm, "obs", "lang", colours)


@query("prune_categories", """SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code, lang AS category
FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'en')""")
def prune_categories(spark, sf):
    """Categories without remaining rows disappear after a selection."""
    lm = _with_lang(spark, sf, _COLOURS).subset(obs=F.col("lang") != "en")
    return lm.obs_categories["lang"].table.select("code", "category")


@query("realign_palette", """SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS code, lang AS category, color
FROM (SELECT lang, printf('#%02x%02x80', CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER), CAST(256 - row_number() OVER (ORDER BY lang) AS INTEGER)) AS color
      FROM (SELECT DISTINCT lang FROM documents)) WHERE lang <> 'en'""")
def realign_palette(spark, sf):
    """Colours follow the surviving categories."""
    lm = _with_lang(spark, sf, _COLOURS).subset(obs=F.col("lang") != "en")
    cats = lm.obs_categories["lang"]
    return cats.table.join(cats.colors, "code").select("code", "category", "color")


@query("subset_raw", """-- uses: ord
SELECT obs_key, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey JOIN part ON var_key = p_partkey
WHERE o_orderstatus = 'O' AND p_brand = 'Brand#3'""")
def subset_raw(spark, sf):
    """Raw sliced by its own variables while X holds fewer."""
    lm = orders_by_part(spark, sf)
    lm = snapshot_raw(lm.subset(var=F.col("p_size") > 40), lm)
    return S.subset_raw(lm, F.col("o_orderstatus") == "O", F.col("p_brand") == "Brand#3").X.cells


@query("raw_to_matrix", """-- uses: ord
SELECT obs_key, o_orderpriority, var_key, p_brand, value FROM ord JOIN orders ON obs_key = o_orderkey JOIN part ON var_key = p_partkey""")
def raw_to_matrix(spark, sf):
    """Raw as a full object with the parent's observations."""
    lm = orders_by_part(spark, sf)
    full = S.raw_matrix(snapshot_raw(lm.subset(var=F.col("p_size") > 40), lm))
    obs = full.obs.select(F.col("key").alias("obs_key"), "o_orderpriority")
    var = full.var.select(F.col("key").alias("var_key"), "p_brand")
    return full.X.cells.join(obs, "obs_key").join(var, "var_key")


@query("drop_rows_cols", """-- uses: ord
SELECT obs_key, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey JOIN part ON var_key = p_partkey
WHERE o_orderstatus <> 'P' AND p_type <> 'ECONOMY'""")
def drop_rows_cols(spark, sf):
    """Selected rows and columns removed."""
    return S.drop(orders_by_part(spark, sf), obs=F.col("o_orderstatus") == "P", var=F.col("p_type") == "ECONOMY").X.cells


@query("replace_by_subset", """-- uses: ord
SELECT var_key, count(*) AS n, sum(value) AS total FROM ord JOIN orders ON obs_key = o_orderkey WHERE o_totalprice > 100000 GROUP BY 1""")
def replace_by_subset(spark, sf):
    """An object rebound to its own subset, then used."""
    lm = orders_by_part(spark, sf)
    lm = lm.subset(obs=F.col("o_totalprice") > 100000)
    return lm.X.cells.groupBy("var_key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("split_by", """-- uses: ord
SELECT o_orderpriority AS part, obs_key, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey""")
def split_by(spark, sf):
    """One subset per priority; stacked again they give all cells."""
    pieces = [sub.X.cells.withColumn("part", F.lit(v)) for v, sub in S.split_by(orders_by_part(spark, sf), "o_orderpriority")]
    return reduce(DataFrame.unionByName, pieces)
