"""Categorical queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import categories as C
from ..operators import nested
from ..plans.local import small_table
from .registry import query
from .tables import documents_by_lang, orders_by_part, table

_NATURAL = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"


@query("strings_to_categories", """SELECT 'p_brand' AS col, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus) FROM orders""")
def strings_to_categories(spark, sf):
    """Text columns with fewer values than rows get dictionaries; unique ones do not."""
    lm = orders_by_part(spark, sf)
    lm = lm.replace(var=lm.var.withColumn("unique", F.concat(F.lit("u"), "key")))
    lm = C.strings_to_categories(lm)
    parts = [c.table.agg(F.lit(k).alias("col"), F.count(F.lit(1)).alias("n")) for cats in (lm.obs_categories, lm.var_categories) for k, c in cats.items()]
    return reduce(DataFrame.unionByName, parts)


@query("strings_to_categories_nulls", """SELECT quality_text AS value, count(*) AS n FROM
(SELECT CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS quality_text FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def strings_to_categories_nulls(spark, sf):
    """Nulls of a categorical column stay null."""
    lm = documents_by_lang(spark, sf)
    lm = lm.replace(obs=lm.obs.withColumn("q", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")))
    lm = C.strings_to_categories(lm, ["obs"])
    codes = C.encode_categories(lm.obs, "q", lm.obs_categories["q"])
    back = C.decode_categories(codes, "q", lm.obs_categories["q"])
    return back.groupBy(F.col("q").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("natural_sort_categories", f"""SELECT CAST(row_number() OVER (ORDER BY {_NATURAL}) - 1 AS INTEGER) AS code, p_brand AS category FROM (SELECT DISTINCT p_brand FROM part)""")
def natural_sort_categories(spark, sf):
    """Brand#2 comes before Brand#10."""
    return C.dictionary(table(spark, sf, "part"), "p_brand").table


@query("encode_categories", f"""WITH d AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY {_NATURAL}) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey AS key, code FROM part JOIN d USING (p_brand)""")
def encode_categories(spark, sf):
    """Rows hold codes of a dictionary stored once."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_brand")
    return C.encode_categories(part, "p_brand", C.dictionary(part, "p_brand")).withColumnRenamed("p_brand", "code")


@query("decode_categories", "SELECT doc_id AS key, CASE quality WHEN 0 THEN 'bad' WHEN 1 THEN 'good' END AS q FROM documents LEFT JOIN labels USING (doc_id)")
def decode_categories(spark, sf):
    """Codes back to values; -1 is missing."""
    from ..model import Categories
    docs = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    coded = docs.select(F.col("doc_id").alias("key"), F.coalesce("quality", F.lit(-1)).alias("q"))
    names = small_table(spark, [(0, "bad"), (1, "good")], "code int, category string")
    return C.decode_categories(coded, "q", Categories(names))


@query("rename_categories", f"""WITH d AS (SELECT p_brand, row_number() OVER (ORDER BY {_NATURAL}) AS k FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey AS key, 'B' || k AS p_brand FROM part JOIN d USING (p_brand)""")
def rename_categories(spark, sf):
    """All brands renamed by position."""
    lm = orders_by_part(spark, sf)
    cats = C.dictionary(lm.var, "p_brand")
    lm = C.rename_categories(lm.replace(var_categories={"p_brand": cats}), "var", "p_brand", [f"B{i + 1}" for i in range(cats.table.count())])
    return lm.var.select("key", "p_brand")


@query("rename_linked_fields", """WITH m AS (SELECT user_id, event_type, CAST(CAST(count(*) AS BIGINT) AS VARCHAR) AS value FROM events GROUP BY 1, 2),
full_users AS (SELECT user_id FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)),
d AS (SELECT event_type, 'E' || row_number() OVER (ORDER BY event_type) AS e FROM (SELECT DISTINCT event_type FROM events))
SELECT 'ranks/' || user_id || '/' || CASE WHEN user_id IN (FROM full_users) THEN e ELSE event_type END AS path, value FROM m JOIN d USING (event_type)
UNION ALL SELECT 'other/' || user_id || '/' || event_type, value FROM m""")
def rename_linked_fields(spark, sf):
    """Record fields of metadata grouped by the column follow a renaming; others stay."""
    events = table(spark, sf, "events")
    m = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("value"))
    leaf = lambda k: m.select(F.array(F.lit(k), F.col("user_id").cast("string"), "event_type").alias("path"), "value")
    tags = nested.from_dict(spark, {"ranks": {"params": {"groupby": "event_type"}}, "other": {"params": {"groupby": "another"}}})
    uns = nested.union(leaf("ranks"), leaf("other"), tags)
    cats = C.dictionary(events, "event_type")
    pairs = cats.table.select("category", F.concat(F.lit("E"), F.col("code") + 1).alias("_new"))
    out = C.rename_linked_fields(uns, "event_type", pairs).where(F.col("path")[1] != "params")
    return out.select(F.array_join("path", "/").alias("path"), "value")
