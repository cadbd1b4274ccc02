"""Query registry and the SQL fragments that describe the shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, if it has one, its SQL."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn
    return add


# SQL of the inputs built in tables.py. A query's SQL names the ones it needs.
INPUTS = {
    "ord": "SELECT l_orderkey AS obs_key, l_partkey AS var_key, sum(l_quantity) AS value, "
           "round(sum(l_extendedprice), 2) AS price, CAST(count(*) AS DOUBLE) AS lines "
           "FROM lineitem GROUP BY 1, 2",
    "cust": "SELECT o_custkey AS obs_key, p_brand AS var_name, sum(l_quantity) AS value, CAST(count(*) AS DOUBLE) AS lines "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "brands": "SELECT p_brand AS name, row_number() OVER (ORDER BY p_brand) - 1 AS pos FROM (SELECT DISTINCT p_brand FROM part)",
    "wide": "SELECT c_custkey AS obs_key, c_name AS obs_name, b.name AS var_name, b.pos AS var_pos, coalesce(value, 0.0) AS value "
            "FROM customer CROSS JOIN brands b LEFT JOIN cust ON cust.obs_key = c_custkey AND cust.var_name = b.name",
    "opos": "SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders",
    "ppos": "SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part",
    "trade": "SELECT o_custkey AS i, l_suppkey AS j, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "evt": "SELECT CAST(user_id AS VARCHAR) AS obs_name, event_type AS var_name, round(sum(value), 4) AS value, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2",
    # three shops: customers by segment, part names with one colour left out of two of them
    "shop_obs": "SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 2 END AS ds, * FROM customer",
    "shop_var": "SELECT ds, p_name AS name, count(*) AS n_parts, max(p_size) AS max_size, CAST(ds AS BIGINT) AS shop "
                "FROM part, (SELECT unnest([0, 1, 2]) AS ds) WHERE NOT (ds = 0 AND p_name LIKE 'small %') AND NOT (ds = 1 AND p_name LIKE 'red %') GROUP BY 1, 2",
    "shop": "SELECT o.ds, o.c_custkey, o.c_name AS obs_name, p_name AS var_name, sum(l_quantity) AS value, CAST(count(*) AS DOUBLE) AS lines "
            "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN shop_obs o ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey "
            "JOIN shop_var v ON v.ds = o.ds AND v.name = p_name GROUP BY 1, 2, 3, 4",
}
_NEEDS = {"wide": ("cust", "brands"), "shop": ("shop_obs", "shop_var")}


def with_inputs(sql: str) -> str:
    """Prefix the SQL with the inputs it names after ``-- uses:``."""
    first, _, body = sql.strip().partition("\n")
    if not first.startswith("-- uses:"):
        return sql.strip()
    names: list[str] = []
    for n in first[len("-- uses:"):].replace(",", " ").split():
        for x in (*_NEEDS.get(n, ()), n):
            if x not in names:
                names.append(x)
    ctes = ",\n".join(f"{n} AS ({INPUTS[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
