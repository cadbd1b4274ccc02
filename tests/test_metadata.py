"""Metadata leaves that are tables, sparse matrices or arrays, and keys checked at construction."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmx import Graph, Matrix, Table, create, concat
from labelmx.operators import nested
from labelmx.plans.local import small_table
from labelmx.sources.bundle import read_bundle, write_bundle
from labelmx.sources.csv_dir import write_csvs


def frame(spark, *values):
    return Table(small_table(spark, list(enumerate(values)), "key bigint, price double"))


def matrix(spark, *edges):
    return Graph(small_table(spark, list(edges), "i_key bigint, j_key bigint, value double"))


def told(lm):
    """Nested mapping of all metadata; tables as lists of rows."""
    out = {k: v for k, v in nested.to_dict(lm.uns).items()}
    for at, el in lm.uns_tables.items():
        node = out
        for k in at[:-1]:
            node = node.setdefault(k, {})
        rows = el.edges if isinstance(el, Graph) else el.rows
        node[at[-1]] = sorted(tuple(r) for r in rows.collect())
    return out


@pytest.fixture
def noted(spark, make):
    def build(tree):
        uns, tables = nested.split_tables(spark, tree)
        return make([[1]], ["r"], ["c"], uns=uns, uns_tables=tables)
    return build


def test_tables_by_strategy(spark, noted):
    t = lambda: frame(spark, 1.5, math.nan)
    a = noted({"n": {"t": t(), "m": matrix(spark, (0, 1, 2.0))}, "x": 1})
    b = noted({"n": {"t": t(), "m": matrix(spark, (0, 1, 2.0), (5, 5, 0.0))}, "x": 1})
    c = noted({"n": {"t": frame(spark, 1.5, 2.5)}, "x": 1})
    merged = lambda lms, s: concat(lms, uns_merge=s)
    assert set(merged([a, b], "same").uns_tables) == {("n", "t"), ("n", "m")}
    assert merged([a, b, c], "same").uns_tables == {} and told(merged([a, b, c], "same")) == {"x": 1}
    assert set(merged([a, b, c], "unique").uns_tables) == {("n", "m")}
    assert told(merged([c, a, b], "first"))["n"]["t"] == [(0, 1.5), (1, 2.5)]
    assert told(merged([a, noted({"y": 2})], "only")) ["n"]["m"] == [(0, 1, 2.0)]
    assert merged([a, b], None).uns_tables == {} and merged([a, b], None).uns is None
    assert set(merged([a, b], lambda leaves, n: nested.merge(leaves, n, "first")).uns_tables) == {("n", "t"), ("n", "m")}


def test_table_meets_leaf_or_mapping(spark, noted):
    table, leaf, deep = noted({"k": frame(spark, 1.0)}), noted({"k": 1}), noted({"k": {"d": 1}})
    for other in (leaf, deep):
        assert told(concat([table, other], uns_merge="same")) == {}
        assert told(concat([table, other], uns_merge="unique")) == {}
        assert told(concat([table, other], uns_merge="first")) == {"k": [(0, 1.0)]}
    assert told(concat([deep, table], uns_merge="first")) == {"k": {"d": 1}}
    assert told(concat([leaf, table], uns_merge="first")) == {"k": 1}
    kinds = [noted({"k": frame(spark, 1.0)}), noted({"k": matrix(spark, (0, 0, 1.0))})]
    assert told(concat(kinds, uns_merge="unique")) == {}


def test_only_tables(spark, noted):
    a = noted({"t": frame(spark)}).replace(uns=None)
    out = concat([a, a], uns_merge="same")
    assert told(out) == {"t": []}


@pytest.mark.parametrize("one, two, equal", [
    ([1, math.nan], [1.0, math.nan], True),
    ([[1, 2], [3, math.nan]], [[1.0, 2], [3, math.nan]], True),
    ([[1, 2], [3]], [[1], [2, 3]], False),
    ([math.nan, 1], [1, math.nan], False),
    ([-math.inf, 2**60], [-math.inf, 2**60 + 1], False),
    (np.array([[1, 2]]), [[1.0, 2.0]], True),
    (["1", "2"], [1, 2], False),
    ([], [], True),
    (math.nan, math.nan, False),
    (["a b", "c"], ["a b", "c"], True),
    (["a b"], ["ab"], False),
])
def test_arrays(noted, one, two, equal):
    out = concat([noted({"k": one}), noted({"k": two})], uns_merge="same")
    assert ("k" in nested.to_dict(out.uns)) is equal


def test_kept_and_stored(spark, make, noted, tmp_path):
    lm = noted({"a/b": {"t": frame(spark, 3.0)}, "m": matrix(spark, (1, 2, 3.0)), "x": [1, math.nan]})
    assert set(lm["r"].T.uns_tables) == {("a/b", "t"), ("m",)}
    path = str(tmp_path / "m")
    write_bundle(lm, path)
    back = told(read_bundle(spark, path))
    assert back["a/b"] == {"t": [(0, 3.0)]} and back["m"] == [(1, 2, 3.0)] and math.isnan(back["x"][1])
    with pytest.warns(UserWarning, match="sparse"):
        write_csvs(lm.replace(uns_tables={("t",): lm.uns_tables["a/b", "t"], ("m",): lm.uns_tables["m",]}), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv/uns/t.csv")).collect()] == ["price", "3.0"]
    with pytest.raises(TypeError, match="a/t"):
        nested.from_dict(spark, {"a": {"t": frame(spark, 1.0)}})
    given = create(lm.X, lm.obs, lm.var, uns={"t": frame(spark, 1.0), "x": 1})
    assert told(given) == {"t": [(0, 1.0)], "x": 1}


def test_keys_at_construction(spark, make):
    lm = make([[1, 2], [3, 4]], ["a", "b"], ["x", "y"])
    cells = lambda *rows: small_table(spark, list(rows), "obs_key bigint, var_key bigint, value double")
    with pytest.raises(ValueError, match=r"X\['X'\]: 2 unknown obs_key; X\['X'\]: 1 unknown var_key"):
        create(cells((77, 99, 1.0), (77, 3, 1.0), (78, 3, 1.0)), lm.obs, lm.var)
    with pytest.raises(ValueError, match=r"layers\['l'\]: 1 unknown obs_key"):
        create(lm.X, lm.obs, lm.var, layers={"l": cells((4, 3, 1.0))})
    with pytest.raises(ValueError, match="obsp"):
        create(lm.X, lm.obs, lm.var, obsp={"g": matrix(spark, (3, 4, 1.0))})
    with pytest.raises(ValueError, match="1 unknown obs_key"):
        create(small_table(spark, [(9, "nobody", 1.0)], "obs_key bigint, var_name string, value double"), lm.obs, lm.var)
    assert create(cells((77, 99, 1.0)), lm.obs, lm.var, check=False).X.cells.count() == 1
    assert create(Matrix(cells((3, 13, 1.0))), lm.obs, lm.var).X.cells.count() == 1
