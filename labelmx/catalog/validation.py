"""Construction, validation and naming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Vectors, axis_table
from ..operators import build as B
from ..operators import names as N
from ..operators import nested
from ..operators import validate as V
from ..operators.concat import reindex
from .registry import query
from .tables import customers_by_brand, documents_by_lang, embedded, named_cells, orders_by_part, table, users_by_event


@query("create", """-- uses: evt
SELECT obs_name, var_name, CAST(value AS DOUBLE) AS value FROM evt""")
def create(spark, sf):
    """Cells given by names, aligned to both axes."""
    return named_cells(users_by_event(spark, sf))


@query("create_cast", """-- uses: cust
SELECT c_name AS obs_name, var_name, CAST(value AS INTEGER) AS value FROM cust JOIN customer ON obs_key = c_custkey""")
def create_cast(spark, sf):
    """Values cast to the requested type."""
    lm = customers_by_brand(spark, sf)
    return named_cells(B.create(lm.X.cells, lm.obs, lm.var, dtype="int"))


@query("homogenize", """SELECT c_custkey, 'c_nationkey' AS var_name, CAST(c_nationkey AS DOUBLE) AS value FROM customer
UNION ALL SELECT c_custkey, 'c_acctbal', c_acctbal FROM customer""")
def homogenize(spark, sf):
    """An integer and a double column in one common type."""
    return B.homogenize(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")


@query("validate_alignment", """SELECT 'obsm' AS slot, 'quality' AS element, 'missing key' AS problem, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL""")
def validate_alignment(spark, sf):
    """Documents that a vector element lacks."""
    lm = documents_by_lang(spark, sf)
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("vec"))
    return V.validate_alignment(lm.replace(obsm={"quality": Vectors(rows, 2)}))


@query("validate_names", """WITH a AS (SELECT p_name AS expected, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
b AS (SELECT p_name AS given, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS pos FROM part)
SELECT pos, expected, given FROM a JOIN b USING (pos) WHERE expected <> given""")
def validate_names(spark, sf):
    """Positions where two name lists differ."""
    lm = _named_parts(spark, sf)
    other = axis_table(table(spark, sf, "part").withColumn("back", -F.col("p_partkey")), key="back", name="p_name")
    flipped = lm.replace(var=other).positions("var").select("pos", "name")
    return V.name_mismatches(lm, "var", flipped)


def _named_parts(spark, sf):
    lm = orders_by_part(spark, sf)
    return lm.replace(var=axis_table(table(spark, sf, "part"), key="p_partkey", name="p_name"))


@query("duplicate_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    """Part names that repeat."""
    return V.duplicate_names(_named_parts(spark, sf), "var")


@query("make_names_unique", """SELECT key, CASE WHEN i = 0 THEN name ELSE name || '-' || i END AS name
FROM (SELECT p_partkey AS key, p_name AS name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS i FROM part)""")
def make_names_unique(spark, sf):
    """Later occurrences of a part name get a number."""
    return N.make_names_unique(_named_parts(spark, sf), "var").var.select("key", "name")


@query("make_names_unique_taken", """WITH base AS (SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN event_type || '-' || (event_id % 40 + 1) ELSE event_type END AS name FROM events),
dup AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY key) - 1 AS i FROM base),
taken AS (SELECT DISTINCT regexp_extract(name, '^(.*)-([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(name, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT) AS t FROM base WHERE name LIKE '%-%'),
shift AS (SELECT base, t - row_number() OVER (PARTITION BY base ORDER BY t) AS u FROM taken),
s AS (SELECT d.key, count(u) AS c FROM dup d LEFT JOIN shift ON base = d.name AND u < i GROUP BY 1)
SELECT dup.key, CASE WHEN i = 0 THEN name ELSE name || '-' || (i + c) END AS name FROM dup JOIN s USING (key)""")
def make_names_unique_taken(spark, sf):
    """Numbers that existing names already use are skipped; few names hold most rows."""
    e = table(spark, sf, "events")
    numbered = F.concat("event_type", F.lit("-"), (F.col("event_id") % 40 + 1).cast("string"))
    named = e.withColumn("n", F.when(F.col("event_id") % 3 == 0, numbered).otherwise(F.col("event_type")))
    axis = axis_table(named.select("event_id", "n"), key="event_id", name="n")
    return N.unique_names(axis).select("key", "name")


@query("set_names", """WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part),
q AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey DESC) - 1 AS pos FROM part)
SELECT p.p_partkey AS key, q.p_name || '/' || q.p_partkey AS name FROM p JOIN q USING (pos)""")
def set_names(spark, sf):
    """Names replaced by position."""
    lm = orders_by_part(spark, sf)
    part = table(spark, sf, "part").withColumn("back", -F.col("p_partkey"))
    given = lm.replace(var=axis_table(part, key="back")).positions("var")
    names = given.select("pos", F.concat("p_name", F.lit("/"), (-F.col("key")).cast("string")).alias("name"))
    return N.set_names(lm, "var", names).var.select("key", "name")


@query("element_stats", """-- uses: ord
SELECT 'X' AS slot, 'X' AS element, count(*) AS n_rows, count(*) FILTER (value <> 0) AS n_nonzero FROM ord
UNION ALL SELECT 'layers', 'price', count(*), count(*) FROM ord UNION ALL SELECT 'layers', 'lines', count(*), count(*) FROM ord
UNION ALL SELECT 'obs', 'obs', count(*), -1 FROM orders UNION ALL SELECT 'var', 'var', count(*), -1 FROM part""")
def element_stats(spark, sf):
    """Rows and non-zero values of every element."""
    return V.element_stats(orders_by_part(spark, sf)).withColumn("n_nonzero", F.coalesce("n_nonzero", F.lit(-1)))


@query("from_wide", """SELECT CAST(c_custkey AS VARCHAR) AS obs_name, 'nation' AS var_name, CAST(c_nationkey AS DOUBLE) AS value FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'balance', c_acctbal FROM customer""")
def from_wide(spark, sf):
    """A wide frame as matrix."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    return named_cells(B.from_wide(c, name="c_custkey", dtype=None))


@query("from_annotation_dict", """SELECT row_number() OVER (ORDER BY c_name) - 1 AS key, c_name AS name, c_mktsegment AS segment FROM customer""")
def from_annotation_dict(spark, sf):
    """Annotation columns with a names column."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("obs_names"), F.col("c_name").alias("at"), F.col("c_mktsegment").alias("segment"))
    return B.from_annotation(c, order="at").select("key", "name", "segment")


@query("from_compressed", """-- uses: ord, opos, ppos
SELECT opos.pos AS obs_key, ppos.pos AS var_key, value FROM ord JOIN opos ON obs_key = o_orderkey JOIN ppos ON var_key = p_partkey""")
def from_compressed(spark, sf):
    """A compressed triplet made from the cells and read back."""
    from ..plans.ranks import ranked, running_total
    lm = orders_by_part(spark, sf)
    place = lambda axis: lm.positions(axis).select(F.col("key").alias(f"{axis}_key"), F.col("pos").alias(f"{axis}_pos"))
    cells = lm.X.cells.join(place("obs"), "obs_key").join(place("var"), "var_key")
    counts = lm.positions("obs").select(F.col("pos").alias("major"), F.col("key").alias("obs_key")).join(
        lm.X.cells.groupBy("obs_key").agg(F.count(F.lit(1)).alias("n")), "obs_key", "left").select("major", F.coalesce("n", F.lit(0)).alias("n"))
    indptr = running_total(counts, "major", F.col("n"), "end").select("major", (F.col("end") - F.col("n")).alias("start"), "end")
    flat = cells.withColumn("at", F.col("obs_pos") * 2**31 + F.col("var_pos"))
    data = ranked(flat, "at", "pos").select("pos", F.col("var_pos").alias("index"), "value")
    return B.from_compressed(data, indptr, lm.shape, dtype=None).X.cells


@query("from_struct", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def from_struct(spark, sf):
    """The named fields of a compound column."""
    c = table(spark, sf, "customer").select(F.struct("c_custkey", "c_name", "c_acctbal").alias("s"))
    return B.from_struct(c, "s")


@query("collapse_constant_columns", """SELECT 'table-obs/channel' AS path, '"store"' AS value, (SELECT count(*) FROM customer) AS n_rows""")
def collapse_constant_columns(spark, sf):
    """A column with one value moves to the metadata."""
    lm = customers_by_brand(spark, sf)
    lm = lm.replace(obs=lm.obs.withColumn("channel", F.lit("store")))
    lm = B.collapse_constant_columns(lm, "obs")
    n = lm.obs.count() if "channel" not in lm.obs.columns else -1
    return lm.uns.select(F.array_join("path", "/").alias("path"), "value", F.lit(n).cast("bigint").alias("n_rows"))


@query("reindex", """-- uses: wide
WITH target AS (SELECT p_brand AS name FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand > 'Brand#2') UNION ALL SELECT DISTINCT event_type FROM events)
SELECT c_name AS obs_name, t.name AS var_name, CASE WHEN w.obs_name IS NULL THEN 9.5 ELSE w.value END AS value
FROM customer CROSS JOIN target t LEFT JOIN wide w ON w.obs_name = c_name AND w.var_name = t.name WHERE w.obs_name IS NULL OR w.value <> 0""")
def reindex_query(spark, sf):
    """Variables realigned to other names; new ones are filled, absent cells stay absent."""
    lm = customers_by_brand(spark, sf)
    brands = table(spark, sf, "part").select(F.col("p_brand").alias("n")).distinct().where("n > 'Brand#2'")
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("n")).distinct()
    target = axis_table(brands.unionByName(kinds), name="n", order="n")
    return named_cells(reindex(lm, "var", target, fill_value=9.5))
