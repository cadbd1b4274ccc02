"""Merge-strategy queries."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, Table, Vectors, annotation
from ..operators import nested
from ..operators.concat import concat
from ..operators.by_values import ByValues
from ..operators.compare import differing_vectors
from ..plans.local import small_table
from .registry import query
from .tables import shops, table

_KEPT = "(SELECT name FROM shop_var GROUP BY 1 HAVING count(*) = 3)"


def _var(spark, sf, merge, join="inner"):
    return concat(shops(spark, sf), merge=merge, join=join).var.drop("key", "ord")


@query("merge_none", f"""-- uses: shop_var
SELECT name FROM {_KEPT}""")
def merge_none(spark, sf):
    """No variable column survives."""
    return _var(spark, sf, None)


@query("merge_same", f"""-- uses: shop_var
SELECT name, max(n_parts) AS n_parts, max(max_size) AS max_size FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_same(spark, sf):
    """Columns of all inputs that agree."""
    return _var(spark, sf, "same")


@query("merge_unique", f"""-- uses: shop_var
SELECT name, max(n_parts) AS n_parts, max(max_size) AS max_size, max(n_parts) + 1 AS last FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_unique(spark, sf):
    """Columns whose copies agree, also if only one input has them."""
    return _var(spark, sf, "unique")


@query("merge_first", f"""-- uses: shop_var
SELECT name, max(n_parts) AS n_parts, max(max_size) AS max_size, min(shop) AS shop, max(n_parts) + 1 AS last FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_first(spark, sf):
    """Every column, from the first input that has it."""
    return _var(spark, sf, "first")


@query("merge_only", f"""-- uses: shop_var
SELECT name, max(n_parts) + 1 AS last FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_only(spark, sf):
    """Columns that one input alone has."""
    return _var(spark, sf, "only")


@query("merge_custom", f"""-- uses: shop_var
SELECT name, max(shop) AS shop, max(n_parts) AS n_parts FROM shop_var GROUP BY 1 HAVING count(*) = 3""")
def merge_custom(spark, sf):
    """A caller's rule: two columns, each from the last input that has it."""
    return _var(spark, sf, lambda present, n: {c: present[c][-1] for c in ("shop", "n_parts") if c in present})


def _profiles(spark, sf, lms):
    """Per shop: a price profile equal in all, a count equal in two, and a price graph."""
    part = table(spark, sf, "part")
    out = []
    for i, lm in enumerate(lms):
        per = part.groupBy(F.col("p_name").alias("name")).agg(F.max("p_retailprice").alias("hi"), F.min("p_retailprice").alias("lo"), F.count(F.lit(1)).cast("double").alias("n"))
        keyed = lm.var.select("key", "name").join(per, "name")
        varm = {
            "price": Vectors(keyed.select("key", F.array("lo", "hi").alias("vec")), 2),
            "count": Vectors(keyed.select("key", F.array(F.col("n") + int(i == 2)).alias("vec")), 1),
        }
        if i == 1:
            varm["single"] = Vectors(keyed.select("key", F.array("n", F.lit(math.nan)).alias("vec")), 2)
        loops = Graph(keyed.select(F.col("key").alias("i_key"), F.col("key").alias("j_key"), F.col("n").alias("value")))
        out.append(lm.replace(varm=varm, varp={"self": loops}))
    return out


@query("merge_alt_axis", f"""-- uses: shop_var
WITH p AS (SELECT p_name AS name, max(p_retailprice) AS hi, min(p_retailprice) AS lo, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1 HAVING p_name IN {_KEPT})
SELECT 'price' AS element, name, lo AS first, hi AS last FROM p UNION ALL SELECT 'single', name, n, NULL FROM p UNION ALL SELECT 'self', name, n, n FROM p""")
def merge_alt_axis(spark, sf):
    """Vectors and graphs of the aligned axis kept where their copies agree."""
    out = concat(_profiles(spark, sf, shops(spark, sf)), merge="unique")
    names = out.var.select("key", "name")
    parts = [
        v.rows.join(names, "key").select(F.lit(k).alias("element"), "name", F.col("vec")[0].alias("first"), F.nanvl(F.element_at("vec", -1), F.lit(None)).alias("last"))
        for k, v in out.varm.items()
    ]
    parts += [g.edges.join(names, g.edges.i_key == names.key).select(F.lit(k).alias("element"), "name", F.col("value").alias("first"), F.col("value").alias("last")) for k, g in out.varp.items()]
    return reduce(DataFrame.unionByName, parts)


def _close(element: str, copies: list) -> bool:
    """Several copies, nowhere more than 1 apart."""
    flat = [c.flatten() if pa.types.is_list(c.type) else c for c in copies]
    near = lambda a, b: pc.all(pc.less_equal(pc.abs(pc.subtract(pc.cast(a, "double"), pc.cast(b, "double"))), 1.0)).as_py()
    return len(flat) > 1 and all(near(flat[0], c) for c in flat[1:])


def _highest(element: str, copies: list):
    if not pa.types.is_list(copies[0].type):
        return pc.max_element_wise(*copies)
    return pa.ListArray.from_arrays(copies[0].offsets, pc.max_element_wise(*[c.flatten() for c in copies]))


@query("merge_by_values", f"""-- uses: shop_var
WITH p AS (SELECT p_name AS name, CAST(max(p_retailprice) AS DOUBLE) AS hi, CAST(min(p_retailprice) AS DOUBLE) AS lo, CAST(count(*) AS DOUBLE) AS n, CAST(max(p_size) AS DOUBLE) AS size
  FROM part GROUP BY 1 HAVING p_name IN {_KEPT})
SELECT 'n_parts' AS element, name, n AS first, n AS last FROM p UNION ALL SELECT 'max_size', name, size, size FROM p
UNION ALL SELECT 'price', name, lo, hi FROM p UNION ALL SELECT 'count', name, n + 1, n + 1 FROM p UNION ALL SELECT 'self', name, n, n FROM p""")
def merge_by_values(spark, sf):
    """A caller's rule on values: copies that are nowhere more than 1 apart give their highest values."""
    out = concat(_profiles(spark, sf, shops(spark, sf)), merge=ByValues(_close, _highest))
    names = out.var.select("key", "name")
    both = lambda v: [v.cast("double").alias("first"), v.cast("double").alias("last")]
    parts = [out.var.select(F.lit(c).alias("element"), "name", *both(F.col(c))) for c in annotation(out.var)]
    parts += [
        v.rows.join(names, "key").select(F.lit(k).alias("element"), "name", F.col("vec")[0].alias("first"), F.element_at("vec", -1).alias("last"))
        for k, v in out.varm.items()
    ]
    parts += [g.edges.join(names, g.edges.i_key == names.key).select(F.lit(k).alias("element"), "name", *both(F.col("value"))) for k, g in out.varp.items()]
    return reduce(DataFrame.unionByName, parts)


@query("element_equal", """SELECT 'changed' AS element, bool_or(list_max(embedding) > 0.3) AS differs FROM embeddings
UNION ALL SELECT 'narrow', bool_or(len(embedding) > 8) FROM embeddings
UNION ALL SELECT 'nan', bool_or(len(embedding) <> 64) FROM embeddings UNION ALL SELECT 'same', bool_or(len(embedding) <> 64) FROM embeddings""")
def element_equal(spark, sf):
    """Whole elements compared; NaN equals NaN."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    swap = lambda to: e.select("key", F.transform("vec", lambda v: F.when(v > 0.3, F.lit(to)).otherwise(v)).alias("vec"))
    pairs = {
        "same": [Vectors(e, 64), Vectors(e.select("key", "vec"), 64)],
        "nan": [Vectors(swap(math.nan), 64), Vectors(swap(math.nan), 64)],
        "changed": [Vectors(e, 64), Vectors(swap(0.0), 64)],
        "narrow": [Vectors(e, 64), Vectors(e.select("key", F.slice("vec", 1, 8).alias("vec")), 8)],
    }
    bad = differing_vectors(pairs)
    return small_table(spark, [(k, k in bad) for k in pairs], "element string, differs boolean")


def _notes(spark, sf):
    """One mapping per event type: user → count, or user → {count, top} for busy users."""
    events = table(spark, sf, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    ds = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])[F.col("event_type")]
    per = events.groupBy(ds.alias("ds"), F.col("user_id").cast("string").alias("u")).agg(
        (F.count(F.lit(1)) % 4).alias("n"), F.max(F.get_json_object("props", "$.k").cast("bigint")).alias("top"))
    flat = per.where("n < 2").select("ds", F.array(F.lit("users"), "u").alias("path"), F.col("n").cast("string").alias("value"))
    deep = per.where("n >= 2").select("ds", F.explode(F.array(
        F.struct(F.array(F.lit("users"), F.col("u"), F.lit("count")).alias("path"), F.col("n").cast("string").alias("value")),
        F.struct(F.array(F.lit("users"), F.col("u"), F.lit("top")).alias("path"), F.floor(F.col("top") / 25).cast("string").alias("value")),
    )).alias("x")).select("ds", "x.*")
    own = per.groupBy("ds").agg(F.count(F.lit(1)).cast("string").alias("value"))
    own = own.select("ds", F.array(F.lit("users"), F.concat(F.lit("kind"), "ds")).alias("path"), "value")
    return flat.unionByName(deep).unionByName(own), len(kinds)


_NOTES = """WITH per AS (SELECT ds, CAST(user_id AS VARCHAR) AS u, count(*) % 4 AS n, max(CAST(props->>'$.k' AS BIGINT)) AS top
  FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS ds FROM (SELECT DISTINCT event_type FROM events)) USING (event_type) GROUP BY 1, 2),
leaves AS (SELECT ds, u, 'leaf' AS k, n AS v FROM per WHERE n < 2 UNION ALL SELECT ds, u, 'count', n FROM per WHERE n >= 2 UNION ALL SELECT ds, u, 'top', top // 25 FROM per WHERE n >= 2
  UNION ALL SELECT ds, 'kind' || ds, 'leaf', count(*) FROM per GROUP BY ds),
users AS (SELECT u, count(DISTINCT ds) AS n_ds, min(ds) AS first_ds, bool_or(k = 'leaf') AS terminal, bool_and(k = 'leaf') AS pure, min(v) = max(v) AS equal FROM leaves GROUP BY 1),
fields AS (SELECT u, k, count(*) AS n_ds, min(ds) AS first_ds, min(v) = max(v) AS equal FROM leaves GROUP BY 1, 2),
n AS (SELECT count(DISTINCT ds) AS all_ds FROM per)
SELECT 'users/' || l.u || CASE WHEN l.k = 'leaf' THEN '' ELSE '/' || l.k END AS path, CAST(l.v AS VARCHAR) AS value
FROM leaves l JOIN users u ON l.u = u.u JOIN fields f ON l.u = f.u AND l.k = f.k, n
WHERE CASE WHEN u.terminal THEN l.ds = u.first_ds AND ({user}) ELSE l.ds = f.first_ds AND ({field}) END"""


def _nested(strategy: str, user: str, field: str):
    @query(f"merge_nested_{strategy}", _NOTES.format(user=user, field=field))
    def run(spark, sf):
        """Nested metadata of all event types merged path by path."""
        tagged, n = _notes(spark, sf)
        return nested.merge(tagged, n, strategy).select(F.array_join("path", "/").alias("path"), "value")


_nested("first", "TRUE", "TRUE")
_nested("unique", "u.pure AND u.equal", "f.equal")
_nested("same", "u.pure AND u.equal AND u.n_ds = all_ds", "f.equal AND u.n_ds = all_ds AND f.n_ds = all_ds")
_nested("only", "u.n_ds = 1", "f.n_ds = 1")


def _noted_shops(spark, sf):
    """Shops with tables among their metadata: regions everywhere, nations in two, own segment counts, an array with NaN."""
    plain = lambda name, key, col: Table(table(spark, sf, name).select(F.col(key).cast("bigint").alias("key"), F.col(col).alias("name")))
    out = []
    for i, lm in enumerate(shops(spark, sf)):
        ref = {"regions": plain("region", "r_regionkey", "r_name")}
        if i:
            ref["nations"] = plain("nation", "n_nationkey", "n_name")
        by_segment = lm.obs.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("key"))
        notes, tables = nested.split_tables(spark, {"ref": ref, "own": {"segments": Table(by_segment)}, "scale": [1, math.nan, 2.0 if i else 2]})
        out.append(lm.replace(uns=notes, uns_tables=tables))
    return out


def _metadata(lm):
    """Every leaf of the metadata: ``(path, key, name)``."""
    parts = [lm.uns.select(F.array_join("path", "/").alias("path"), F.lit(None).cast("bigint").alias("key"), F.col("value").alias("name"))]
    parts += [el.rows.select(F.lit("/".join(at)).alias("path"), "key", "name") for at, el in lm.uns_tables.items()]
    return reduce(DataFrame.unionByName, parts)


_REGIONS = """SELECT 'ref/regions' AS path, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region
UNION ALL SELECT 'scale', NULL, '[1, NaN, 2]'"""
_NATIONS = " UNION ALL SELECT 'ref/nations', CAST(n_nationkey AS BIGINT), n_name FROM nation"


def _with_tables(strategy: str, sql: str):
    @query(f"merge_uns_tables_{strategy}", f"-- uses: shop_obs\n{sql}")
    def run(spark, sf):
        """Tables and arrays among the metadata merged path by path."""
        return _metadata(concat(_noted_shops(spark, sf), uns_merge=strategy))


_with_tables("same", _REGIONS)
_with_tables("unique", _REGIONS + _NATIONS)
_with_tables("first", _REGIONS + _NATIONS + " UNION ALL SELECT 'own/segments', count(*), c_mktsegment FROM shop_obs WHERE ds = 0 GROUP BY 3")
