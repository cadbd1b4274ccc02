"""Sparse vectors as elements of an axis, and wide tables from packed blocks."""

import time

import pytest
from pyspark.sql import functions as F

from labelmx import ByValues, SparseVectors, Vectors, concat
from labelmx.operators import build as B
from labelmx.operators import select as S
from labelmx.operators import validate as V
from labelmx.operators.update import set_element
from labelmx.plans.local import small_table
from labelmx.sources.bundle import append, read_bundle, write_bundle

WIDE = 1_000_000


def entries(el):
    return sorted(map(tuple, el.rows.select("key", "index", "value").collect()))


def sparse(spark, rows, width=WIDE):
    return SparseVectors(small_table(spark, rows, "key bigint, index bigint, value double"), width)


@pytest.fixture
def pair(spark, make):
    a = make([[1, 2], [0, 3]], ["a0", "a1"], ["x", "y"], sparse=True, obsm={"v": sparse(spark, [(3, 999_999, 4.0), (13, 7, 5.0), (3, 2, 1.5)])})
    b = make([[5, 6]], ["b0"], ["x", "y"], sparse=True, obsm={"v": sparse(spark, [(3, 2, -1.0), (3, 5, 8.0)], 6)})
    return a, b


def test_selection_and_checks(spark, pair):
    a, _ = pair
    assert entries(a["a0"].obsm["v"]) == [(3, 2, 1.5), (3, 999_999, 4.0)]
    assert entries(a[[1, 0]].obsm["v"]) == [(0, 7, 5.0), (1, 2, 1.5), (1, 999_999, 4.0)]
    assert V.validate_alignment(a).isEmpty()
    bad = a.replace(obsm={"v": sparse(spark, [(3, 6, 1.0), (3, 6, 2.0), (4, 0, 1.0), (13, -1, 1.0)], 6)})
    found = {r.problem: r.n for r in V.validate_alignment(bad).collect()}
    assert found == {"index out of range": 3, "repeated entry": 2, "unknown key": 1}
    with pytest.raises(ValueError, match="does not align"):
        V.check_element(a, "obsm", "v", bad.obsm["v"])
    assert entries(set_element(a, "obsm", "w", a.obsm["v"]).obsm["w"]) == entries(a.obsm["v"])
    assert {r.element: r.n_nonzero for r in V.element_stats(a).collect() if r.slot == "obsm"} == {"v": 3}


def test_split(spark, pair):
    a, _ = pair
    a = a.replace(obs=a.obs.withColumn("side", F.col("name")))
    assert {v: len(entries(lm.obsm["v"])) for v, lm in S.split_by(a, "side")} == {"a0": 2, "a1": 1}


def named(lm, k):
    rows = lm.obs.select("key", "name").join(lm.obsm[k].rows, "key")
    return sorted((r.name, r["index"], r.value) for r in rows.collect())


def test_stacking(spark, pair):
    a, b = pair
    outer = concat([a, b], join="outer")
    assert outer.obsm["v"].width == WIDE
    assert named(outer, "v") == [("a0", 2, 1.5), ("a0", 999_999, 4.0), ("a1", 7, 5.0), ("b0", 2, -1.0), ("b0", 5, 8.0)]
    inner = concat([a, b])
    assert inner.obsm["v"].width == 6 and named(inner, "v") == [("a0", 2, 1.5), ("b0", 2, -1.0), ("b0", 5, 8.0)]
    assert "Array" not in inner.obsm["v"].rows._jdf.queryExecution().optimizedPlan().toString()


def test_stacking_with_dense_missing_and_filled(spark, make, pair):
    _, b = pair
    dense = make([[1, 1]], ["d"], ["x", "y"], sparse=True, obsm={"v": Vectors(spark.sql("SELECT 3L AS key, array(0D, 2D) AS vec"), 2)})
    none = make([[1, 1]], ["n"], ["x", "y"], sparse=True)
    out = concat([b, dense, none], join="outer")
    assert named(out, "v") == [("b0", 2, -1.0), ("b0", 5, 8.0), ("d", 1, 2.0)]
    filled = concat([b, dense, none], join="outer", fill_value=9.0)
    assert named(filled, "v") == sorted(
        [("b0", 2, -1.0), ("b0", 5, 8.0), ("d", 1, 2.0)] + [("d", i, 9.0) for i in range(2, 6)] + [("n", i, 9.0) for i in range(6)]
    )


def test_merging(spark, make):
    def one(rows, width=6, **kw):
        return make([[1, 1]], ["r"], ["x", "y"], sparse=True, varm={"v": sparse(spark, rows, width)})

    a = one([(3, 1, 2.0), (13, 4, 0.0)])
    same, other, narrow = one([(3, 1, 2.0)]), one([(3, 1, 2.5)]), one([(3, 1, 2.0)], 5)
    assert entries(concat([a, same], merge="same").varm["v"])[0] == (3, 1, 2.0)
    assert "v" not in concat([a, other], merge="same").varm
    assert "v" not in concat([a, narrow], merge="same").varm
    assert "v" in concat([a, other], merge="first").varm
    last = ByValues(value=lambda name, copies: copies[-1])
    assert (3, 1, 2.5) in entries(concat([a, other], merge=last).varm["v"])


def test_stored_appended_and_dense(spark, pair, tmp_path):
    a, b = pair
    path = str(tmp_path / "m")
    write_bundle(a, path)
    back = read_bundle(spark, path)
    assert back.obsm["v"].width == WIDE and entries(back.obsm["v"]) == entries(a.obsm["v"])
    append(spark, path, b.replace(obsm={"v": SparseVectors(b.obsm["v"].rows, WIDE)}))
    assert len(entries(read_bundle(spark, path).obsm["v"])) == 5
    dense = B.to_vectors(b.obsm["v"], b.obs)
    assert dense.rows.first().vec == [0.0, 0.0, -1.0, 0.0, 0.0, 8.0]
    assert entries(B.to_sparse_vectors(dense)) == entries(b.obsm["v"])
    with pytest.raises(ValueError, match="widths"):
        append(spark, path, b)


def test_wide_by_blocks(spark, make):
    lm = make([[1, None, 3, 4, 0], [0, 7, None, 0, 0]], ["p", "q"], ["a", "b", "c", "d`", "e"])
    got = {r["name"]: r for r in lm.to_wide(width=2).collect()}
    assert [got["p"][i] for i in (1, 3, 4, 5)] == [1, 3, 4, 0] and got["p"][2] != got["p"][2]
    picked = lm.to_wide(columns=["e", "b", "a"], width=2)
    assert picked.columns == ["name", "e", "b", "a"]
    assert {r[0]: r[3] for r in picked.collect()} == {"p": 1.0, "q": 0.0}
    with pytest.raises(KeyError):
        lm.to_wide(columns=["a", "zzz"])
    with pytest.raises(ValueError):
        lm.to_wide(columns=["a", "a"])


def test_wide_plans_many_columns_in_seconds(spark):
    n = 27_899
    cells = spark.range(2 * n).selectExpr("id % 2 AS obs_key", "id div 2 AS var_key", "CAST(id AS double) AS value")
    axis = lambda k: spark.range(k).selectExpr("id AS key", "id AS ord", "concat('v', id) AS name")
    lm = B.create(cells, axis(2), axis(n), dtype=None).replace(obs_dense=True, var_dense=True)
    start = time.monotonic()
    plan = lm.to_wide()._jdf.queryExecution().executedPlan().toString()
    assert time.monotonic() - start < 60
    assert "Pivot" not in plan and plan.count("ObjectHashAggregate") + plan.count("SortAggregate") <= 2
