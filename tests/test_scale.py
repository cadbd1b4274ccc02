"""Plans that keep their shape when the data grow: gaps, samples, pieces and text lines."""
import math
import re

import pytest
from pyspark.sql import functions as F

from labelmx import Graph, Matrix, Vectors, concat, tune
from labelmx.operators import reshape as R
from labelmx.operators import select as S
from labelmx.plans.durable import stored
from labelmx.plans.local import small_table
from labelmx.session import PART_BYTES
from labelmx.sources import text

from helpers import column, grid, names


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved(df):
    """Exchanges of rows in a plan; broadcasts are none."""
    return sum(f"Exchange {how}partitioning" in line for line in plan_of(df).splitlines() for how in ("hash", "range"))


def test_gaps_of_a_matrix(make):
    values = [[None if (i + j) % 3 == 0 else float(i * j) for j in range(70)] for i in range(4)] + [[float(j + 1) for j in range(70)], [None] * 70]
    lm = make(values, [f"o{i}" for i in range(6)], [f"v{j}" for j in range(70)])
    for width in (64, 4096):
        found = {(r.obs_key, r.var_key) for r in R.gaps(lm, lm.X, width=width).collect()}
        assert found == {(10 * i + 3, 10 * j + 3) for i, row in enumerate(values) for j, v in enumerate(row) if v is None}
    thin = R.sparsify(lm.X, lm)
    assert thin.sparse and grid(lm, thin) == values
    kept = {(r.obs_key, r.var_key): r.value for r in thin.cells.collect()}
    assert all(v != 0 for v in kept.values()) and sum(math.isnan(v) for v in kept.values()) == sum(v is None for row in values for v in row)


def test_sparsify_without_axes_loses_nothing(make):
    lm = make([[1.0, None], [0.0, 2.0]], ["a", "b"], ["x", "y"])
    same = R.sparsify(lm.X)
    assert grid(lm, same) == [[1.0, None], [0.0, 2.0]] and not same.sparse
    zero = Matrix(lm.X.cells, 0.0)
    assert R.sparsify(zero).cells.count() == 2


def test_gaps_of_an_empty_matrix(spark, make):
    lm = make([[None, None]], ["a"], ["x", "y"])
    assert grid(lm, R.sparsify(lm.X, lm)) == [[None, None]]
    none = make([], [], ["x"])
    assert R.gaps(none, none.X).isEmpty()


def test_sample_keeps_one_rule(make, monkeypatch):
    lm = make([[float(i)] for i in range(40)], [f"o{i}" for i in range(40)], ["x"])
    small = grid(R.sample_rows(lm, 9, replace=False, seed=5))
    by_position = [r.pos for r in R.sample_positions(lm, 9, replace=False, seed=5).orderBy("new_key").collect()]
    assert small == [[float(p)] for p in by_position] and len({p for p in by_position}) == 9
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 4)
    assert grid(R.sample_rows(lm, 9, replace=False, seed=5)) == small
    assert len(grid(R.sample_rows(lm, 99, replace=False, seed=5))) == 40
    first = R._drawn_keys(lm, 3, 5)
    assert [r.key for r in first.orderBy("new_key").collect()] == [10 * p + 3 for p in by_position[:3]]


def test_drawing_few_rows_moves_no_axis(spark, make):
    lm = make([[float(i)] for i in range(40)], [f"o{i}" for i in range(40)], ["x"])
    big = lm.replace(obs=spark.range(10_000).select(F.col("id").alias("key"), F.col("id").alias("ord"), F.col("id").cast("string").alias("name")))
    assert "TakeOrderedAndProject" in plan_of(R._drawn_keys(big, 5, 1))
    assert "rangepartitioning" not in plan_of(R._drawn_keys(big, 5, 1))


def test_pieces_of_every_element(spark, make):
    kinds = ["b", None, "a", "b", "b", "b"]
    lm = make(
        [[float(10 * i + j) for j in range(3)] for i in range(6)], [f"o{i}" for i in range(6)], ["x", "y", "z"],
        obs_cols={"kind": kinds}, layers={"twice": [[float(i)] * 3 for i in range(6)]},
    )
    vec = spark.range(6).select((10 * F.col("id") + 3).alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    edges = small_table(spark, [(10 * i + 3, 10 * j + 3, 1.0) for i in range(6) for j in range(6)], "i_key bigint, j_key bigint, value double")
    lm = lm.replace(obsm={"v": Vectors(vec, 2)}, obsp={"g": Graph(edges)})
    pieces = list(S.split_by(lm, "kind"))
    assert [v for v, _ in pieces] == [None, "a", "b"]
    for value, piece in pieces:
        at = [i for i, k in enumerate(kinds) if k == value]
        assert names(piece, "obs") == [f"o{i}" for i in at] and column(piece, "obs", "kind") == [value] * len(at)
        assert grid(piece) == [[float(10 * i + j) for j in range(3)] for i in at]
        assert grid(piece, piece.layers["twice"]) == [[float(i)] * 3 for i in at]
        assert sorted(r.vec[0] for r in piece.obsm["v"].rows.collect()) == [float(i) for i in at]
        assert piece.obsp["g"].edges.count() == len(at) ** 2
    # a piece reads its own folder only, whatever the matrix was computed from
    assert all("PartitionFilters: [isnotnull(_piece" in plan_of(p.X.cells) and moved(p.X.cells) == 0 for _, p in pieces)


def test_lines_are_never_exchanged(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    for part in range(3):
        head = "name,x,y\n" if part == 0 else ""
        (folder / f"part-{part}.csv").write_text(head + "".join(f"r{part}_{i},{i},{part}\n" + "\n" * (i % 2) for i in range(5)))
    lm = text.read_csv(spark, str(folder))
    assert moved(lm.X.cells) == 0 and moved(lm.obs) == 0
    assert names(lm, "obs") == [f"r{p}_{i}" for p in range(3) for i in range(5)]
    assert column(lm, "obs", "ord") == list(range(15))
    assert grid(lm) == [[float(i), float(p)] for p in range(3) for i in range(5)]


def test_parts_of_an_exchange_are_small(spark):
    """Small parts are joined up to a few MB only, so hash tables over them do not grow with the input."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    had = spark.conf.getAll.get(size)
    try:
        spark.conf.unset(size)
        tune(spark)
        assert int(spark.conf.get(size)) == PART_BYTES
        spark.conf.set(size, "1m")
        tune(spark)
        assert spark.conf.get(size) == "1m"  # what the session names stays
    finally:
        spark.conf.set(size, had) if had else spark.conf.unset(size)


def test_stacked_pieces_share_exchanges(spark, make):
    """Pieces of one matrix read its cells by the same plan, whatever their keys are shifted by."""
    lm = make([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], ["a", "b", "c"], ["x", "y"], sparse=True, obs_cols={"kind": ["p", "q", "r"]})
    cells = spark.createDataFrame(lm.X.cells.collect(), lm.X.cells.schema).groupBy("obs_key", "var_key").agg(F.sum("value").alias("value"))
    lm = lm.replace(X=Matrix(cells), obsp={"g": Graph(lm.X.cells.select(F.col("obs_key").alias("i_key"), F.col("obs_key").alias("j_key"), "value"))})
    pieces = {k: lm.subset(obs=F.col("kind") == k) for k in ("p", "q", "r")}
    size = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        out = concat(pieces, label="piece", pairwise=True)
        held = out.X.cells.join(out.obs.select(F.col("key").alias("obs_key"), "name"), "obs_key")
        text = held._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(size, had)
    assert not re.search(r"isnotnull\(\(obs_key#\d+L \+ -?\d+\)", text)
    assert grid(out) == [[1, 2], [3, 4], [5, 6]] and column(out, "obs", "piece") == ["p", "q", "r"]
    assert sorted((r.i_key, r.j_key, r.value) for r in out.obsp["g"].edges.collect()) == sorted((k.key, k.key, v) for k, vs in zip(out.obs.orderBy("ord").collect(), ((1, 2), (3, 4), (5, 6))) for v in vs)


def test_umi_lines_are_cut_once(spark, tmp_path, monkeypatch):
    """Lines are cut into fields as they are read; axes are numbered from stored names."""
    (tmp_path / "u.tsv").write_text("anything\ng1\tc1\t3\n\ng2\tc1\t1\ng1\tc1\t5\ng1\tc2\t2\n")
    kept = {}
    monkeypatch.setattr(text, "stored", lambda df, stem="table": kept.setdefault(f"{stem}{len(kept)}", stored(df, stem)))
    lm = text.read_umi_counts(spark, str(tmp_path / "u.tsv"), dtype="double")
    assert names(lm, "obs") == ["c1", "c2"] and names(lm, "var") == ["g1", "g2"] and grid(lm) == [[5, 1], [2, 0]]
    assert [k.rstrip("0123456789") for k in kept] == ["lines", "splits", "seen", "seen"]
    assert {"gene", "cell", "count"} <= set(kept["lines0"].columns)
    (tmp_path / "short.tsv").write_text("gene\tcell\tcount\ng1\tc1\t3\ng2\tc1\n")
    with pytest.raises(Exception, match="no count in line"):
        text.read_umi_counts(spark, str(tmp_path / "short.tsv")).X.cells.collect()
