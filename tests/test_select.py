"""Selection, access and updates on small exact cases."""
import pytest
from pyspark.sql import functions as F

from labelmx import Categories, Graph, Matrix, Vectors, create
from labelmx.operators import access as A
from labelmx.operators import select as S
from labelmx.operators import update as U
from labelmx.operators import validate as V
from labelmx.operators.categories import set_palette
from labelmx.plans.local import small_table

from helpers import column, grid, names


@pytest.fixture
def lm(make):
    return make([[1, 2, 3], [4, 5, 6]], ["A", "B"], ["a", "b", "c"], obs_cols={"kind": ["x", "y"]}, var_cols={"w": [1, 2, 3]})


def test_slices(lm):
    assert grid(lm[0]) == [[1, 2, 3]]
    assert grid(lm[-1]) == [[4, 5, 6]]
    assert grid(lm[0, 1]) == [[2]]
    assert grid(lm[:, 1:3]) == [[2, 3], [5, 6]]
    assert grid(lm[::-1, ::2]) == [[4, 6], [1, 3]]
    assert grid(lm[:, -2:]) == [[2, 3], [5, 6]]
    assert grid(lm[:, "a":"b"]) == [[1, 2], [4, 5]]
    assert grid(lm["B", "c"]) == [[6]]
    assert grid(lm[["B", "A"], ["c", "a"]]) == [[6, 4], [3, 1]]
    assert grid(lm[[1, 0, 1]]) == [[4, 5, 6], [1, 2, 3], [4, 5, 6]]
    assert grid(lm[[False, True], [True, False, True]]) == [[4, 6]]
    assert grid(lm[[[True], [False]]]) == [[1, 2, 3]]
    assert grid(lm[F.col("kind") == "y"]) == [[4, 5, 6]]
    assert grid(lm[["B", "A"]][:, ["c"]][0]) == [[6]]
    assert lm[:] is not None and lm.subset().X is lm.X


def test_selection_errors(lm):
    with pytest.raises(KeyError, match="Z"):
        lm[["A", "Z"]]
    with pytest.raises(KeyError):
        lm["Z"]
    with pytest.raises(IndexError, match="3.*2"):
        lm[[True, False, True]]
    with pytest.raises(IndexError):
        lm[[0, 5]]
    with pytest.raises(IndexError):
        lm[7]


def test_every_element_follows(spark, lm):
    vec = Vectors(small_table(spark, [(3, 1.0), (13, 2.0)], "key bigint, v double").select("key", F.array("v").alias("vec")), 1)
    graph = Graph(small_table(spark, [(3, 13, 1.0), (13, 13, 2.0)], "i_key bigint, j_key bigint, value double"))
    lm = U.snapshot_raw(lm.replace(obsm={"p": vec}, obsp={"g": graph}, layers={"two": Matrix(lm.X.cells, lm.X.absent)}), lm)
    sub = lm[["B"], ["c"]]
    assert grid(sub, sub.layers["two"]) == [[6]]
    assert [r.vec for r in sub.obsm["p"].rows.collect()] == [[2.0]]
    (edge,) = sub.obsp["g"].edges.collect()
    assert edge.i_key == edge.j_key == sub.obs.first()["key"]
    assert grid(sub.replace(var=sub.raw.var, var_dense=True), sub.raw.X) == [[4, 5, 6]]
    twice = lm[[1, 1]]
    assert twice.obsp["g"].edges.count() == 4
    assert S.subset_raw(sub, None, ["b", "a"]).X.cells.count() == 2
    assert S.raw_matrix(sub).shape == (1, 3)


def test_drop_and_split(lm):
    assert grid(S.drop(lm, obs=["A"], var=["b"])) == [[4, 6]]
    assert {v: grid(sub) for v, sub in S.split_by(lm, "kind")} == {"x": [[1, 2, 3]], "y": [[4, 5, 6]]}


def test_value_predicate_counts_absent(make):
    lm = make([[0, 2], [5, 0], [0, 0]], ["A", "B", "C"], ["a", "b"], sparse=True)
    assert names(S.subset_by_value(lm, "obs", "a", lambda v: v == 0), "obs") == ["A", "C"]


def test_palette(spark, make):
    lines = ["u3", "u1", "u3", "u7", "u1"]
    lm = make(None, [f"stop{i}" for i in range(5)], ["g"], obs_cols={"line": lines})
    cats = Categories(small_table(spark, [(0, "u1"), (1, "u3"), (2, "u7")], "code int, category string"))
    lm = lm.replace(obs_categories={"line": cats})
    ridden = set_palette(lm, "obs", "line", ["#080", "#c00", "#00f"])[["stop0", "stop3"]].obs_categories["line"]
    assert [r.category for r in ridden.table.orderBy("code").collect()] == ["u3", "u7"]
    assert [r.color for r in ridden.colors.orderBy("code").collect()] == ["#c00", "#00f"]
    # fewer colours than categories cannot be realigned
    assert set_palette(lm, "obs", "line", ["#080", "#c00"])[["stop0"]].obs_categories["line"].colors is None


def test_vectors(make):
    sold = [[4, 0, 0, 10], [0, 0, 6, 2], [0, 8, 0, 0]]
    days, goods = ["mon", "tue", "wed"], ["tea", "rice", "salt", "oil"]
    lm = make(sold, days, goods, sparse=True, obs_cols={"staff": [3, 5, 2], "oil": [0, 1, 0]})
    full = U.snapshot_raw(lm, lm)
    half = full.replace(X=Matrix(lm.X.cells.withColumn("value", F.col("value") / 2)))
    values = lambda df: [r.value for r in df.orderBy("ord").collect()]
    for j, good in enumerate(goods[:3]):
        assert values(half.obs_vector(good)) == [r[j] / 2 for r in sold]
        assert values(A.raw_vector(half, "obs", good)) == [r[j] for r in sold]
    assert values(half.obs_vector("staff")) == [3, 5, 2]
    assert values(half.var_vector("tue")) == [v / 2 for v in sold[1]]
    assert values(A.raw_vector(half, "obs", "oil")) == [10, 2, 0]
    with pytest.raises(ValueError, match="both"):
        lm.obs_vector("oil")
    with pytest.raises(KeyError):
        lm.obs_vector("flour")
    with pytest.raises(ValueError):
        A.pick_matrix(half, layer="x", use_raw=True)
    with pytest.raises(ValueError):
        A.pick_matrix(lm, use_raw=True)
    wide = {r["name"]: [r[g] for g in goods] for r in lm.to_wide().collect()}
    assert wide == dict(zip(days, sold))


def test_more_columns_than_two_thousand(spark):
    n = 2100
    obs = small_table(spark, [(0, 0, "only")], "key bigint, ord bigint, name string")
    var = spark.range(n).selectExpr("id AS key", "id AS ord", "concat('v', id) AS name")
    cells = spark.range(n).selectExpr("0L AS obs_key", "id AS var_key", "CAST(id AS double) AS value").where("value > 0")
    wide = create(cells, obs, var, dtype=None).to_wide()
    assert wide.columns == ["name", *[f"v{i}" for i in range(n)]]
    assert wide.first()[1:] == tuple(float(i) for i in range(n))


def test_updates(spark, make, lm):
    assert grid(U.set_matrix(lm, 7)) == [[7, 7, 7], [7, 7, 7]]
    assert U.set_matrix(lm, None).X is None
    assert grid(U.assign_block(lm, ["B"], ["a", "c"], 0.5)) == [[1, 2, 3], [0.5, 5, 0.5]]
    block = small_table(spark, [(3, 3, 9.0), (13, 13, 8.0)], "obs_key bigint, var_key bigint, value double")
    assert grid(U.assign_block(lm, None, ["a"], block)) == [[9, 2, 3], [None, 5, 6]]
    assert grid(U.assign_cells(lm, block)) == [[9, 2, 3], [4, 8, 6]]
    twice = small_table(spark, [(3, 3, 9.0, 1), (3, 3, 7.0, 2)], "obs_key bigint, var_key bigint, value double, at int")
    for write in (U.assign_cells, U.update_existing_only):
        assert grid(write(lm, twice, order="at")) == [[7, 2, 3], [4, 5, 6]]
        with pytest.raises(ValueError, match="more than once"):
            write(lm, twice)
        with pytest.raises(ValueError, match="outside"):
            write(lm, small_table(spark, [(99, 3, 1.0)], "obs_key bigint, var_key bigint, value double"))
    assert grid(lm) == [[1, 2, 3], [4, 5, 6]]
    column_vector = small_table(spark, [(3, 1.5), (13, 2.5)], "key bigint, value double")
    assert grid(U.set_matrix(lm[:, "a"], column_vector)) == [[1.5], [2.5]]
    with pytest.raises(ValueError):
        U.set_matrix(lm, column_vector)
    stray = small_table(spark, [(99, 3, 1.0)], "obs_key bigint, var_key bigint, value double")
    with pytest.raises(ValueError, match="does not align"):
        U.set_matrix(lm, stray)
    with pytest.raises(ValueError, match="layers"):
        U.set_element(lm, "layers", "bad", Matrix(stray))


def test_existing_only(spark, make):
    lm = make([[0, 2], [5, 0]], ["A", "B"], ["a", "b"], sparse=True)
    cells = lambda rows: small_table(spark, rows, "obs_key bigint, var_key bigint, value double")
    assert grid(U.update_existing_only(lm, cells([(3, 13, 9.0)]))) == [[0, 9], [5, 0]]
    assert grid(U.update_existing_only(lm, cells([(3, 3, 0.0), (13, 3, 0.0)]))) == [[0, 2], [0, 0]]
    with pytest.raises(ValueError, match="not stored"):
        U.update_existing_only(lm, cells([(3, 3, 1.0)]))


def test_elements_and_annotation(spark, lm):
    vec = small_table(spark, [(3, 1.0)], "key bigint, v double").select("key", F.array("v").alias("vec"))
    with pytest.raises(ValueError, match="missing"):
        U.set_element(lm, "obsm", "p", Vectors(vec, 1))
    with pytest.raises(TypeError):
        U.set_element(lm, "obsm", "p", lm.X)
    with pytest.raises(KeyError):
        U.drop_element(lm, "layers", "nothing")
    two = small_table(spark, [(0, 5), (1, 6)], "pos bigint, value bigint")
    assert column(U.set_column(lm, "obs", "n", two), "obs", "n") == [5, 6]
    with pytest.raises(ValueError, match="2"):
        U.set_column(lm, "var", "n", two)
    new = small_table(spark, [(1, "Q", 2), (0, "P", 1)], "pos bigint, name string, z bigint")
    out = U.replace_annotation(lm, "obs", new)
    assert names(out, "obs") == ["P", "Q"] and column(out, "obs", "z") == [1, 2] and names(lm, "obs") == ["A", "B"]
    with pytest.raises(ValueError):
        U.snapshot_raw(lm, "not a matrix")
    assert U.snapshot_raw(lm, None).raw is None


def test_create_rules(spark, lm):
    assert create(lm) is lm
    with pytest.raises(ValueError):
        create(lm, lm.obs)
    assert create(shape=(3, 2)).shape == (3, 2)
    with pytest.raises(ValueError):
        create(lm.X, lm.obs, lm.var, shape=(2, 3))
    assert create(lm.X, lm.obs, lm.var).X.cells.schema["value"].dataType.simpleString() == "float"
    assert V.validate_alignment(lm).isEmpty()
    with pytest.raises(ValueError, match="two-dimensional"):
        create(lm.X.cells.drop("var_key"), lm.obs, lm.var)


def test_transpose_law(lm):
    assert grid(lm.T) == [[1, 4], [2, 5], [3, 6]]
    assert grid(lm.T.T) == grid(lm)
    assert grid(lm.T[["b"], ["B", "A"]]) == [[5, 2]]
