"""Typed comparison of copies and strategies on values."""
import datetime
import math

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from labelmx import ByValues, Graph, Table, Vectors, concat
from labelmx.model import annotation
from labelmx.operators.compare import differing_columns, differing_vectors, equal_values
from labelmx.plans.local import small_table

from helpers import column, names

BIG = 2**53


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("a, a_kind, b, b_kind, same", [
    (BIG, "bigint", BIG + 1, "bigint", False), (BIG + 1, "bigint", float(BIG), "double", False), (BIG, "bigint", float(BIG), "double", True),
    (2**63 - 1, "bigint", float(2**63), "double", False), (math.nan, "double", math.nan, "float", True), (-0.0, "double", 0, "int", True),
    (0.5, "double", 0, "int", False), (None, "bigint", None, "double", True), (None, "double", 0.0, "double", False), (1, "tinyint", True, "boolean", True),
    ("1", "string", 1, "int", False), ([1, None], "array<bigint>", [1.0, None], "array<double>", True), ([1], "array<bigint>", [1.0, 2.0], "array<double>", False),
    ({"a": 1}, "map<string,int>", {"a": 1}, "map<string,int>", True), ({"a": 1}, "map<string,int>", {"a": 2}, "map<string,int>", False),
    (datetime.date(2020, 1, 2), "date", datetime.date(2020, 1, 2), "date", True), (math.inf, "double", 2**62, "bigint", False),
])
def test_equal_values(spark, a, a_kind, b, b_kind, same):
    df = spark.createDataFrame([(a, b)], f"a {a_kind}, b {b_kind}")
    kinds = [f.dataType for f in df.schema]
    for x, xk, y, yk in (("a", kinds[0], "b", kinds[1]), ("b", kinds[1], "a", kinds[0])):
        assert df.select(equal_values(F.col(x), xk, F.col(y), yk)).first()[0] is same


def test_columns_that_differ(spark):
    rows = lambda *v: spark.createDataFrame([(f"n{i}", *r) for i, r in enumerate(v)], "name string, same int, null int, nan double, some int, text string")
    one = rows((1, 1, 1.0, 1, "x"), (2, None, math.nan, 2, "y"))
    two = rows((1, 1, 1.0, 1, "x"), (2, None, math.nan, 2, "z")).withColumn("same", F.col("same").cast("double"))
    short = rows((1, 1, 1.0, 1, "x")).select("name", "some")
    cols = ["same", "null", "nan", "some", "text"]
    tables = [(0, one), (1, two), (2, short)]
    assert differing_columns(tables, one.select("name"), cols) == {"null", "nan", "some", "text"}
    assert differing_columns(tables, one.select("name").where("name = 'n0'"), cols) == set()
    assert differing_columns(tables, one.select("name").limit(0), cols) == set()


def test_elements_that_differ(spark):
    vec = lambda *v, kind="double": Vectors(spark.createDataFrame([(i, list(r)) for i, r in enumerate(v)], f"key bigint, vec array<{kind}>"), 2)
    edges = lambda *e: Graph(small_table(spark, e, "i_key bigint, j_key bigint, value double"))
    rows = lambda *r: Table(spark.createDataFrame([(i, *x) for i, x in enumerate(r)], "key bigint, a int, b string"))
    copies = {
        "nan": [vec((1.0, math.nan)), vec((1.0, math.nan))], "types": [vec((1, 2), kind="bigint"), vec((1.0, 2.0))],
        "value": [vec((1.0, 2.0)), vec((1.0, 2.0)), vec((1.0, 3.0))], "longer": [vec((1.0, 2.0)), vec((1.0, 2.0), (0.0, 0.0))],
        "zero edge": [edges((1, 2, 5.0), (2, 2, 0.0)), edges((1, 2, 5.0))], "edge": [edges((1, 2, 5.0)), edges((2, 1, 5.0))],
        "table": [rows((1, "x"), (None, None)), rows((1, "x"), (None, None))], "cell": [rows((1, "x")), rows((1, "y"))],
        "kinds": [vec((1.0, 2.0)), rows((1, "x"))], "empty": [edges(), edges()],
    }
    assert differing_vectors(copies) == {"value", "longer", "edge", "cell", "kinds"}


def test_comparison_sorts_and_melts_nothing(spark, make, monkeypatch):
    plans, frame = [], type(spark.range(1))
    first = frame.first
    monkeypatch.setattr(frame, "first", lambda self: plans.append(plan_of(self)) or first(self))
    one = make(None, ["o"], ["a", "b"], var_cols={"c": [1, 2], "d": ["x", "y"]})
    two = make(None, ["p"], ["b", "a"], var_cols={"c": [2, 1], "d": ["y", "z"]})
    assert annotation(concat([one, two], merge="unique").var) == ["c"]
    (verdict,) = [p for p in plans if "_0_0" in p]
    assert "HashAggregate" in verdict and "SortAggregate" not in verdict and "Generate" not in verdict


def test_strategy_on_values(spark, make):
    one = make(None, ["o"], ["a", "b", "c"], var_cols={"w": [1.0, 2.0, 3.0], "far": [1.0, 2.0, 3.0], "tag": ["p", "q", "r"]})
    two = make(None, ["o"], ["c", "a", "b"], var_cols={"w": [5.0, 1.0, 3.0], "far": [3.0, 9.0, 2.0]})
    key = lambda lm: {r.name: r.key for r in lm.var.collect()}
    vec = lambda lm, v: Vectors(spark.createDataFrame([(key(lm)[k], x) for k, x in v.items()], "key bigint, vec array<double>"), 2)
    graph = lambda lm, e: Graph(spark.createDataFrame([(key(lm)[i], key(lm)[j], x) for i, j, x in e], "i_key bigint, j_key bigint, value double"))
    one = one.replace(varm={"v": vec(one, {"a": [1.0, 1.0], "b": [2.0, 2.0], "c": [3.0, 3.0]})}, varp={"g": graph(one, [("a", "b", 1.0), ("a", "c", 2.0)])})
    two = two.replace(varm={"v": vec(two, {"a": [3.0, 1.0], "b": [2.0, 4.0], "c": [3.0, 5.0]})}, varp={"g": graph(two, [("a", "b", 5.0), ("b", "b", 7.0)])})

    def keep(element, copies):
        return element in ("v", "g") or len(copies) == 2 and pc.all(pc.less_equal(pc.abs(pc.subtract(*copies)), 2.0)).as_py()

    def value(element, copies):
        if element == "g":
            return pc.max_element_wise(*copies)
        a, b = [c.flatten() if element == "v" else c for c in copies]
        mean = pc.divide(pc.add(a, b), 2.0)
        return pa.ListArray.from_arrays(copies[0].offsets, mean) if element == "v" else mean

    out = concat([one, two], merge=ByValues(keep, value))
    assert names(out, "var") == ["a", "b", "c"] and annotation(out.var) == ["w"] and column(out, "var", "w") == [1.0, 2.5, 4.0]
    at = {k: n for n, k in key(out).items()}
    assert {at[r.key]: r.vec for r in out.varm["v"].rows.collect()} == {"a": [2.0, 1.0], "b": [2.0, 3.0], "c": [3.0, 4.0]}
    assert {(at[r.i_key], at[r.j_key]): r.value for r in out.varp["g"].edges.collect()} == {("a", "b"): 5.0, ("a", "c"): 2.0, ("b", "b"): 7.0}
    first = concat([one, two], merge=ByValues())
    assert annotation(first.var) == ["w", "far", "tag"] and column(first, "var", "far") == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="gave 1 values for"):
        concat([one, two], merge=ByValues(lambda e, c: e == "w", lambda e, c: pa.array([0.0]))).var.collect()


def test_strategy_on_tables_and_outer_names(spark, make):
    one = make(None, ["o"], ["a", "b"], var_cols={"n": [1, 2]})
    two = make(None, ["o"], ["b", "c"], var_cols={"n": [7, 8]})
    t = lambda lm, v: lm.replace(varm={"t": Table(lm.var.select("key", F.lit(v).alias("x"), F.col("name").alias("y")))})
    rule = ByValues(None, lambda e, copies: pc.coalesce(*reversed(copies)) if e == "n" else copies[-1])
    out = concat([t(one, 1), t(two, 2)], join="outer", merge=rule)
    assert column(out, "var", "n") == [1, 7, 8]
    rows = {r.key: (r.x, r.y) for r in out.varm["t"].rows.collect()}
    assert sorted(rows.values(), key=str) == [(2, "b"), (2, "c"), (None, None)]
