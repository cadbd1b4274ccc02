"""Stacking queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import LabeledMatrix, SparseVectors, Table, Vectors
from ..operators.concat import align, concat, concatenate
from ..operators.merge import key_order
from ..operators.reshape import densify
from ..operators.update import snapshot_raw
from .registry import query
from .tables import embedded, named_cells, orders_by_part, purchases, shops

_SHARED = "(SELECT name FROM shop_var GROUP BY 1 HAVING count(*) = 3)"


@query("concat_obs", f"""-- uses: shop
SELECT obs_name, var_name, value FROM shop WHERE var_name IN {_SHARED}""")
def concat_obs(spark, sf):
    """Three shops stacked over their shared part names."""
    return named_cells(concat(shops(spark, sf)))


@query("concat_same_axis", """-- uses: ord
SELECT o_orderpriority AS source, obs_key AS obs, var_key, value FROM ord JOIN orders ON obs_key = o_orderkey""")
def concat_same_axis(spark, sf):
    """Pieces that share one variable table need no alignment join."""
    lm = orders_by_part(spark, sf)
    pieces = {p: lm.subset(obs=F.col("o_orderpriority") == p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
    out = concat(pieces, label="source")
    obs = out.obs.select(F.col("key").alias("obs_key"), F.col("name").cast("bigint").alias("obs"), "source")
    return out.X.cells.join(obs, "obs_key").select("source", "obs", "var_key", "value")


@query("concat_var", """-- uses: ord
SELECT obs_key, p_size > 25 AS big, var_key, value FROM ord JOIN part ON var_key = p_partkey""")
def concat_var(spark, sf):
    """Two column halves side by side."""
    lm = orders_by_part(spark, sf)
    halves = {k: lm.subset(var=c) for k, c in (("big", F.col("p_size") > 25), ("small", F.col("p_size") <= 25))}
    out = concat(halves, axis="var", label="half")
    var = out.var.select(F.col("key").alias("var_key"), F.col("name").cast("bigint").alias("v"), (F.col("half") == "big").alias("big"))
    return out.X.cells.join(var, "var_key").select("obs_key", "big", F.col("v").alias("var_key"), "value")


@query("align_inner", """-- uses: shop_var
SELECT name, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT name FROM shop_var GROUP BY 1 HAVING count(*) = 3)""")
def align_inner(spark, sf):
    """Shared names in the first input's order."""
    to = align(shops(spark, sf), "var", "inner")
    return LabeledMatrix(to.target, to.target).positions("var").select("name", "pos")


@query("align_outer", "SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS pos FROM (SELECT DISTINCT p_name FROM part)")
def align_outer(spark, sf):
    """All names, sorted as the inputs differ."""
    to = align(shops(spark, sf), "var", "outer")
    return LabeledMatrix(to.target, to.target, var_dense=to.dense).positions("var").select("name", "pos")


@query("fill_missing", """-- uses: shop
WITH names AS (SELECT DISTINCT p_name AS n FROM part)
SELECT obs_name, var_name, value FROM shop
UNION ALL SELECT c_name, n, -1.5::DOUBLE FROM shop_obs o CROSS JOIN names WHERE NOT EXISTS (SELECT 1 FROM shop_var v WHERE v.ds = o.ds AND v.name = n)""")
def fill_missing(spark, sf):
    """Cells that alignment introduces get the fill value, absent ones stay 0."""
    return named_cells(concat(shops(spark, sf), join="outer", fill_value=-1.5))


@query("concat_mixed", """-- uses: shop
SELECT obs_name, var_name, value FROM shop WHERE var_name IN (SELECT name FROM shop_var GROUP BY 1 HAVING count(*) = 3)""")
def concat_mixed(spark, sf):
    """One dense and two sparse inputs give a sparse result without the dense zeros."""
    a, b, c = shops(spark, sf)
    return named_cells(concat([a.replace(X=densify(a)), b, c]))


@query("label_source", """-- uses: shop_obs
SELECT c_name AS name, ['north', 'south', 'west'][ds + 1] AS shop FROM shop_obs""")
def label_source(spark, sf):
    """A column that tells the input of each observation."""
    return concat(dict(zip(("north", "south", "west"), shops(spark, sf))), label="shop").obs.select("name", "shop")


@query("suffix_names", """-- uses: shop_obs
SELECT c_name || '_' || ds AS name, CAST(ds AS VARCHAR) AS batch FROM shop_obs""")
def suffix_names(spark, sf):
    """Names made distinct by the input's key."""
    return concat(shops(spark, sf), label="batch", index_unique="_").obs.select("name", "batch")


@query("concat_annotation", """-- uses: shop_obs
SELECT c_name AS name, c_acctbal, c_mktsegment, CAST(CASE WHEN ds < 2 THEN c_nationkey END AS DOUBLE) AS c_nationkey, CAST(CASE WHEN ds = 2 THEN c_nationkey END AS DOUBLE) AS nation FROM shop_obs""")
def concat_annotation(spark, sf):
    """All annotation columns, null where an input lacks one."""
    obs = concat(shops(spark, sf), join="outer").obs
    return obs.select("name", "c_acctbal", "c_mktsegment", F.col("c_nationkey").cast("double"), F.col("nation").cast("double"))


@query("concat_annotation_inner", """SELECT c_name AS name, c_acctbal, c_mktsegment FROM customer""")
def concat_annotation_inner(spark, sf):
    """Only the annotation columns all inputs have."""
    return concat(shops(spark, sf)).obs.drop("key", "ord")


@query("concat_layers", """-- uses: shop
WITH names AS (SELECT DISTINCT p_name AS n FROM part)
SELECT obs_name, var_name, lines AS value FROM shop WHERE ds < 2
UNION ALL SELECT c_name, n, 7.0::DOUBLE FROM shop_obs o CROSS JOIN names WHERE o.ds = 2 OR NOT EXISTS (SELECT 1 FROM shop_var v WHERE v.ds = o.ds AND v.name = n)""")
def concat_layers(spark, sf):
    """A layer one input lacks is filled there over all variables."""
    out = concat(shops(spark, sf), join="outer", fill_value=7.0)
    return named_cells(out, out.layers["lines"])


def _with_vectors(spark, sf):
    """Embeddings in three label groups, cut to widths 64, 16 and 40; the last has no short element."""
    lm = embedded(spark, sf)
    groups = [F.col("label") < 3, (F.col("label") >= 3) & (F.col("label") < 6), F.col("label") >= 6]
    out = []
    for i, (cond, width) in enumerate(zip(groups, (64, 16, 40))):
        sub = lm.subset(obs=cond)
        rows = sub.obsm["X_emb"].rows.select("key", F.slice("vec", 1, width).alias("vec"))
        obsm = {"X_emb": Vectors(rows, width)}
        if i < 2:
            obsm["short"] = Vectors(rows.select("key", F.slice("vec", 1, 4).alias("vec")), 4)
        out.append(sub.replace(obsm=obsm))
    return out


_WIDTH = "CASE WHEN label < 3 THEN 64 WHEN label < 6 THEN 16 ELSE 40 END"


@query("concat_vectors", f"""SELECT CAST(vec_id AS VARCHAR) AS name,
  array_to_string([CASE WHEN i <= {_WIDTH} THEN CAST(round(1000 * CAST(embedding[i] AS DOUBLE)) AS INTEGER) ELSE -1 END FOR i IN range(1, 65)], ',') AS emb,
  array_to_string([CASE WHEN label < 6 THEN CAST(round(1000 * CAST(embedding[i] AS DOUBLE)) AS INTEGER) ELSE -1 END FOR i IN range(1, 5)], ',') AS short FROM embeddings""")
def concat_vectors(spark, sf):
    """Vectors padded to the widest input; an input without the element is all fill."""
    out = concat(_with_vectors(spark, sf), join="outer", fill_value=-0.001)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("int").cast("string")), ",")
    rows = out.obsm["X_emb"].rows.withColumnRenamed("vec", "e").join(out.obsm["short"].rows.withColumnRenamed("vec", "s"), "key")
    return out.obs.join(rows, "key").select("name", text("e").alias("emb"), text("s").alias("short"))


@query("concat_vectors_inner", """SELECT CAST(vec_id AS VARCHAR) AS name, CAST(16 AS INTEGER) AS width, CAST(embedding[16] AS DOUBLE) AS last FROM embeddings""")
def concat_vectors_inner(spark, sf):
    """Vectors cut to the narrowest input; only shared elements stay."""
    out = concat(_with_vectors(spark, sf))
    (name, v), = out.obsm.items()
    return out.obs.join(v.rows, "key").select("name", F.size("vec").alias("width"), F.element_at("vec", -1).alias("last"))


@query("concat_vector_tables", """-- uses: shop_obs
SELECT c_name AS name, CASE WHEN ds < 2 THEN c_acctbal END AS balance, CAST(CASE WHEN ds = 0 THEN c_nationkey END AS DOUBLE) AS nation FROM shop_obs""")
def concat_vector_tables(spark, sf):
    """Typed tables side by side: all columns, null where an input lacks them."""
    a, b, c = shops(spark, sf)
    money = lambda lm, cols: Table(lm.obs.select("key", *cols))
    a = a.replace(obsm={"t": money(a, [F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation")])})
    b = b.replace(obsm={"t": money(b, [F.col("c_acctbal").alias("balance")])})
    out = concat([a, b, c], join="outer")
    return out.obs.select("key", "name").join(out.obsm["t"].rows, "key").select("name", "balance", "nation")


def _with_baskets(spark, sf):
    """Shops whose customers have what they bought by part number: a million wide, 500 wide, and without."""
    a, b, c = shops(spark, sf)
    bought = purchases(spark, sf).groupBy(F.col("o_custkey").alias("key"), F.col("l_partkey").cast("bigint").alias("index"))
    bought = bought.agg(F.sum("l_quantity").cast("double").alias("value"))
    basket = lambda lm, n: {"basket": SparseVectors(bought.where(F.col("index") < n).join(lm.obs.select("key"), "key", "left_semi"), n)}
    return a.replace(obsm=basket(a, 1_000_000)), b.replace(obsm=basket(b, 500)), c


_BASKET = """SELECT o.ds, c_name AS name, CAST(l_partkey AS BIGINT) AS index, CAST(sum(l_quantity) AS DOUBLE) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN shop_obs o ON o_custkey = c_custkey GROUP BY 1, 2, 3"""


@query("concat_sparse_vectors", f"""-- uses: shop_obs
SELECT name, index, value, CAST(1000000 AS INTEGER) AS width FROM ({_BASKET}) WHERE ds = 0 OR ds = 1 AND index < 500""")
def concat_sparse_vectors(spark, sf):
    """Vectors of a million entries stacked without arrays; an input without the element adds no entry."""
    return _named_entries(concat(list(_with_baskets(spark, sf)), join="outer"), "basket")


@query("concat_sparse_vectors_inner", f"""-- uses: shop_obs
SELECT name, index, value, CAST(500 AS INTEGER) AS width FROM ({_BASKET}) WHERE ds < 2 AND index < 500""")
def concat_sparse_vectors_inner(spark, sf):
    """Cut to the narrowest input."""
    return _named_entries(concat(list(_with_baskets(spark, sf))[:2]), "basket")


def _named_entries(lm, k):
    el = lm.obsm[k]
    return lm.obs.select("key", "name").join(el.rows, "key").select("name", "index", "value", F.lit(el.width).alias("width"))


@query("block_diagonal", """-- uses: shop_obs, trade
SELECT a.c_name AS i_name, b.c_name AS j_name, value FROM trade JOIN shop_obs a ON i = a.c_custkey JOIN shop_obs b ON j = b.c_custkey WHERE a.ds = b.ds""")
def block_diagonal(spark, sf):
    """Graphs of the shops side by side; edges between shops do not exist."""
    out = concat(shops(spark, sf, graph=True), pairwise=True)
    side = lambda k: out.obs.select(F.col("key").alias(f"{k}_key"), F.col("name").alias(f"{k}_name"))
    return out.obsp["trade"].edges.join(side("i"), "i_key").join(side("j"), "j_key").select("i_name", "j_name", "value")


@query("concat_raw", """-- uses: shop
SELECT obs_name || '/' || ds AS obs_name, var_name, value FROM shop WHERE var_name IN (SELECT name FROM shop_var GROUP BY 1 HAVING count(*) = 3)""")
def concat_raw(spark, sf):
    """Raw parts stacked with the same options while X holds fewer variables."""
    lms = [snapshot_raw(lm.subset(var=F.col("name").startswith("blue")), lm) for lm in shops(spark, sf)]
    out = concat(lms, index_unique="/")
    return named_cells(out.replace(var=out.raw.var), out.raw.X)


@query("concatenate_legacy", f"""-- uses: shop
SELECT obs_name || '-' || ds AS obs_name, CAST(ds AS VARCHAR) AS batch, var_name, value FROM shop WHERE var_name IN {_SHARED}""")
def concatenate_legacy(spark, sf):
    """The method form: batch column, suffixed names."""
    out = concatenate(*shops(spark, sf))
    obs = out.obs.select(F.col("key").alias("obs_key"), F.col("name").alias("obs_name"), "batch")
    var = out.var.select(F.col("key").alias("var_key"), F.col("name").alias("var_name"))
    return out.X.cells.join(obs, "obs_key").join(var, "var_key").select("obs_name", "batch", "var_name", "value")


@query("merge_outer_suffix", """-- uses: shop_var
SELECT name, max(n_parts) AS n_parts, max(max_size) AS max_size, max(CASE WHEN ds = 0 THEN shop END) AS "shop-0", max(CASE WHEN ds = 1 THEN shop END) AS "shop-1",
  max(CASE WHEN ds = 2 THEN shop END) AS "shop-2", max(CASE WHEN ds = 2 THEN n_parts + 1 END) AS "last-2" FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_outer_suffix(spark, sf):
    """Variable columns equal everywhere keep their name, others appear per input."""
    return concatenate(*shops(spark, sf)).var.drop("key", "ord")


def _name_lists(spark, sf):
    """Part names of each shop in the shop's order, shops from last to first."""
    lms = shops(spark, sf)[::-1]
    return reduce(DataFrame.unionByName, [lm.positions("var").select(F.lit(i).alias("ds"), F.col("pos").alias("at"), F.col("name").alias("key")) for i, lm in enumerate(lms)]), len(lms)


@query("shared_keys", """-- uses: shop_var
SELECT name AS key, row_number() OVER (ORDER BY name) - 1 AS pos FROM shop_var GROUP BY name HAVING count(*) = 3""")
def shared_key_order(spark, sf):
    """Names every shop has, in first-seen order."""
    return key_order(*_name_lists(spark, sf), "shared")


@query("all_keys", """SELECT name AS key, row_number() OVER (ORDER BY name) - 1 AS pos FROM (SELECT DISTINCT p_name AS name FROM part)""")
def all_key_order(spark, sf):
    """Names any shop has, in first-seen order."""
    return key_order(*_name_lists(spark, sf), "all")
