"""Stacking, alignment, fill and merge strategies on exact cases."""
import math

import pytest
from pyspark.sql import functions as F

from labelmx import Graph, Table, Vectors, concat, concatenate
from labelmx.model import annotation
from labelmx.operators import nested
from labelmx.operators.concat import align, reindex
from labelmx.operators.merge import all_keys, shared_keys
from labelmx.operators.reshape import transpose
from labelmx.operators.select import split_by
from labelmx.operators.update import snapshot_raw
from labelmx.plans.local import small_table

from helpers import column, grid, names

X = [[1, 2, 3], [4, 5, 6]]


STALLS = {  # prices per stall, by fruit: orders differ and no stall sells everything
    "north": ["pear", "plum", "fig", "kiwi"], "harbour": ["kiwi", "fig", "nut"], "market": ["nut", "fig", "pear", "kiwi", "date"],
}


def price(stall, day, fruit):
    return float((len(stall) * 7 + day * 3 + len(fruit) * ord(fruit[1])) % 5)


def stalls(make, sparse=False, **more):
    out = []
    for stall, fruits in STALLS.items():
        rows = [[price(stall, d, f) for f in fruits] for d in range(2)]
        out.append(make(rows, [f"{stall[0]}{d}" for d in range(2)], fruits, sparse=sparse, layers={"again": rows}, **more.get(stall, {})))
    return out


def plain_stack(join, gap):
    """Names and rows as nested lists: shared fruits as the first stall lists them, or all fruits sorted."""
    lists = list(STALLS.values())
    fruits = [f for f in lists[0] if all(f in x for x in lists)] if join == "inner" else sorted({f for x in lists for f in x})
    return fruits, [[price(s, d, f) if f in sold else gap for f in fruits] for s, sold in STALLS.items() for d in range(2)]


@pytest.mark.parametrize("join", ["inner", "outer"])
@pytest.mark.parametrize("sparse, fill", [(False, None), (False, -4.5), (True, None), (True, -4.5)])
def test_stacked_values(make, join, sparse, fill):
    out = concat(stalls(make, sparse), join=join, fill_value=fill)
    fruits, rows = plain_stack(join, fill if fill is not None else 0.0 if sparse else None)
    assert names(out, "var") == fruits and grid(out) == rows and out.X.sparse == sparse
    if join == "outer" or fill is None:
        assert grid(out, out.layers["again"]) == rows


def test_annotation_of_the_older_form(make):
    origin = {"pear": 4, "plum": 4, "fig": 9, "kiwi": 2, "nut": 7, "date": 1}
    lists = STALLS
    marks = {
        "north": {"var_cols": {"origin": [origin[f] for f in lists["north"]], "shelf": [1, 2, 3, 4]}, "obs_cols": {"open": [8, 9]}},
        "harbour": {"var_cols": {"origin": [origin[f] for f in lists["harbour"]], "shelf": [3, 3, 3]}, "obs_cols": {"open": [7, 7]}},
        "market": {"var_cols": {"origin": [origin[f] for f in lists["market"]]}, "obs_cols": {"rain": ["no", "yes"]}},
    }
    out = concatenate(*stalls(make, **marks), join="outer", batch_key="stall", batch_categories=list(STALLS))
    assert names(out, "obs") == [f"{s[0]}{d}-{s}" for s in STALLS for d in range(2)]
    assert column(out, "obs", "stall") == [s for s in STALLS for _ in range(2)]
    assert column(out, "obs", "open") == [8, 9, 7, 7, None, None] and column(out, "obs", "rain") == [None] * 4 + ["no", "yes"]
    # in an outer join no stall knows all fruits, so every column appears once per stall
    assert annotation(out.var) == ["origin-harbour", "shelf-harbour", "origin-market", "origin-north", "shelf-north"]
    fruits = names(out, "var")
    assert column(out, "var", "shelf-north") == [lists["north"].index(f) + 1 if f in lists["north"] else None for f in fruits]
    inner = concatenate(*stalls(make, **marks))
    # "shelf" is in two of three inputs
    assert annotation(inner.var) == ["origin", "shelf-0", "shelf-1"]
    assert column(inner, "var", "origin") == [origin[f] for f in names(inner, "var")]


def test_dense_below_sparse(make):
    a = make([[0, 8, 0, 6]], ["s"], ["w", "x", "y", "z"], sparse=True)
    dense = make([[5, 0, None]], ["d"], ["z", "x", "w"])
    mixed = concat([a, dense], join="outer")
    assert mixed.X.sparse and names(mixed, "var") == ["w", "x", "y", "z"]
    assert grid(mixed) == [[0, 8, 0, 6], [None, 0, 0, 5]] and mixed.X.cells.where("value = 0").isEmpty()


def test_missing_layer(make):
    a = make([[1, 1]], ["a"], list("xy"), layers={"l": [[3, 4]]})
    b = make([[1, 1]], ["b"], list("xy"))
    assert "l" not in concat([a, b]).layers
    assert grid(concat([a, b], join="outer"), concat([a, b], join="outer").layers["l"]) == [[3, 4], [None, None]]
    out = concat([a, b], join="outer", fill_value=0.5)
    assert grid(out, out.layers["l"]) == [[3, 4], [0.5, 0.5]]


def test_order_of_aligned_names(make):
    m = lambda v: make(None, ["o"], list(v))
    assert names(concat([m("ba"), m("abc")]), "var") == ["b", "a"]
    assert names(concat([m("ba"), m("ba")], join="outer"), "var") == ["b", "a"]
    assert names(concat([m("ba"), m("ca")], join="outer"), "var") == ["a", "b", "c"]
    assert names(concat([m("ba"), m("")], join="outer"), "var") == ["b", "a"]
    assert names(concat([m("ab"), m("")]), "var") == []
    with pytest.raises(ValueError, match="unique"):
        concat([m("aa"), m("ab")])


def vectors(spark, lm, rows, width, absent=math.nan):
    keys = [r.key for r in lm.obs.orderBy("ord").collect()]
    df = small_table(spark, [(k, *r) for k, r in zip(keys, rows)], "key bigint, " + ", ".join(f"c{i} double" for i in range(width)))
    return Vectors(df.select("key", F.array(*[f"c{i}" for i in range(width)]).alias("vec")), width, absent)


def test_vectors_and_tables(spark, make):
    sizes, widths = (2, 3, 1), (3, 1, 2)
    lms = [make(None, [f"r{i}.{j}" for j in range(n)], ["v"]) for i, n in enumerate(sizes)]
    number = lambda i, row, col: float(100 * i + 10 * row + col)
    full = [[[number(i, r, c) for c in range(w)] for r in range(n)] for i, (n, w) in enumerate(zip(sizes, widths))]
    owned = []
    for i, lm in enumerate(lms):
        obsm = {"place": vectors(spark, lm, full[i], widths[i])}
        if i != 1:
            obsm["counts"] = vectors(spark, lm, full[i], widths[i], 0.0)
        cols = [(F.col("ord") * (i + 1)).alias("turn"), *([F.col("name").alias("label")] if i else [])]
        owned.append(lm.replace(obsm={**obsm, "notes": Table(lm.obs.select("key", *cols))}))
    rows = lambda lm, k: [list(r.vec) for r in lm.obs.select("key", "ord").join(lm.obsm[k].rows, "key").orderBy("ord").collect()]
    inner = concat(owned)
    assert sorted(inner.obsm) == ["notes", "place"] and inner.obsm["notes"].columns == ["turn"]
    assert rows(inner, "place") == [r[:min(widths)] for part in full for r in part]
    outer = concat(owned, join="outer", fill_value=0.25)
    padded = lambda r: r + [0.25] * (max(widths) - len(r))
    assert rows(outer, "place") == [padded(r) for part in full for r in part]
    assert rows(outer, "counts") == [padded(r) if i != 1 else [0.25] * 3 for i, part in enumerate(full) for r in part]
    assert outer.obsm["counts"].absent == 0
    notes = outer.obs.select("key", "ord").join(outer.obsm["notes"].rows, "key").orderBy("ord").collect()
    assert [r.turn for r in notes] == [r * (i + 1) for i, n in enumerate(sizes) for r in range(n)]
    assert [r.label for r in notes] == [None, None, "r1.0", "r1.1", "r1.2", "r2.0"]
    with pytest.raises(NotImplementedError):
        concat([owned[0], owned[2].replace(obsm={"place": owned[2].obsm["notes"]})])


def test_graphs(spark, make):
    edges = lambda rows: Graph(small_table(spark, rows, "i_key bigint, j_key bigint, value double"))
    a = make(None, ["a", "b"], ["v"], obsp={"g": edges([(3, 13, 1.0)])})
    b = make(None, ["c", "d"], ["v"], obsp={"g": edges([(13, 3, 2.0)]), "h": edges([(3, 3, 5.0)])})
    assert concat([a, b]).obsp == {}
    out = concat([a, b], pairwise=True, join="outer")
    place = {r.key: r.ord for r in out.obs.collect()}
    show = lambda g: sorted((place[r.i_key], place[r.j_key], r.value) for r in g.edges.collect())
    assert show(out.obsp["g"]) == [(0, 1, 1.0), (3, 2, 2.0)] and show(out.obsp["h"]) == [(2, 2, 5.0)]
    assert list(concat([a, b], pairwise=True).obsp) == ["g"]


def test_columns_of_the_other_axis(make):
    one = make([[1.0, 2.0]], ["o"], ["a", "b"], obs_cols={"g": [1]}, var_cols={"same": [1, 2], "nan": [math.nan, 1.0], "diff": [1, 2], "mine": [4, 5]})
    two = make([[1.0, 2.0]], ["p"], ["b", "a"], obs_cols={"g": [2]}, var_cols={"same": [2, 1], "nan": [1.0, math.nan], "diff": [1, 2]})
    kept = lambda s: annotation(concat([one, two], merge=s).var)
    assert kept(None) == [] and kept("same") == ["same"] and kept("unique") == ["same", "mine"]
    assert kept("first") == ["same", "nan", "diff", "mine"] and kept("only") == ["mine"]
    assert kept(lambda present, n: {"diff": 1} if "diff" in present else {}) == ["diff"]
    out = concat([one, two], merge="first")
    assert names(out, "var") == ["a", "b"] and column(out, "var", "same") == [1, 2]
    assert column(concat([one, two], merge=lambda p, n: {"diff": 1} if "diff" in p else {}), "var", "diff") == [2, 1]


def test_labels_raw_and_axes(make):
    lms = {"x": make(X, ["s", "t"], list("abc")), "y": make(X, ["s", "t"], list("abc"))}
    out = concat(lms, label="src", index_unique="/")
    assert names(out, "obs") == ["s/x", "t/x", "s/y", "t/y"] and column(out, "obs", "src") == ["x", "x", "y", "y"]
    assert [r.category for r in out.obs_categories["src"].table.orderBy("code").collect()] == ["x", "y"]
    with pytest.raises(TypeError):
        concat(lms, keys=["1", "2"])
    a, b = lms.values()
    side = concat([a, b], axis="var")
    assert grid(side) == [r + r for r in X]
    assert grid(transpose(concat([transpose(a), transpose(b)]))) == grid(side)
    both = concat([snapshot_raw(a[:, ["c"]], a), snapshot_raw(b[:, ["a", "c"]], b)])
    assert names(both, "var") == ["c"] and grid(both.replace(var=both.raw.var, var_dense=False), both.raw.X) == X + X
    with pytest.warns(UserWarning, match="raw"):
        assert concat([snapshot_raw(a, a), b]).raw is None


def test_split_then_concat(make):
    lm = make([[i, i + 1] for i in range(6)], list("abcdef"), ["x", "y"], obs_cols={"k": list("ppqqpr")})
    out = concat([sub for _, sub in split_by(lm, "k")])
    assert dict(zip(names(out, "obs"), grid(out))) == dict(zip(names(lm, "obs"), grid(lm)))


def test_zero_width(make):
    a = make([[1, 2]], ["a"], ["x", "y"], sparse=True)
    b = make([[]], ["b"], [], sparse=True)
    assert grid(concat([a, b], join="outer")) == [[1, 2], [0, 0]]
    assert concat([a, b]).shape == (2, 0)


def test_reindex(spark, make):
    lm = make([[1, 0], [0, 4]], ["a", "b"], ["x", "y"], sparse=True, var_cols={"w": [5, 6]})
    to = make(None, ["o"], ["z", "y", "q"]).var
    out = reindex(lm, "var", to.select("key", "ord", "name"), fill_value=9.0)
    assert grid(out) == [[9, 0, 9], [9, 4, 9]] and column(out, "var", "w") == [None, 6, None]
    with pytest.raises(ValueError, match="unique"):
        reindex(lm, "var", to.select("key", "ord", F.lit("q").alias("name")))


def test_key_sets():
    maps = [{"b": 1, "a": 2}, {"a": 3, "c": 4}]
    assert shared_keys(maps) == ["a"] and all_keys(maps) == ["b", "a", "c"]


NESTED = [  # inputs, then the expected result per strategy
    ([{"seed": 7, "depth": 3}, {"seed": 8, "depth": 3}, {"depth": 3}],
     {"first": {"seed": 7, "depth": 3}, "unique": {"depth": 3}, "same": {"depth": 3}, "only": {}}),
    ([{"fit": {"steps": 40, "loss": {"train": 0.5}}}, {"fit": {"steps": 40, "loss": {"test": 0.75}}}],
     {"first": {"fit": {"steps": 40, "loss": {"train": 0.5, "test": 0.75}}}, "same": {"fit": {"steps": 40}}, "only": {"fit": {"loss": {"train": 0.5, "test": 0.75}}}}),
    ([{"by": "hand"}, {"by": {"tool": "saw"}, "at": "noon"}], {"first": {"by": "hand", "at": "noon"}, "unique": {"at": "noon"}, "same": {}, "only": {"at": "noon"}}),
    ([{"by": {"tool": {"maker": "x"}}}, {"by": "hand"}], {"first": {"by": {"tool": {"maker": "x"}}}, "unique": {}, "same": {}, "only": {}}),
    ([{"axes": [3, 5.5, 8]}, {"axes": [3.0, 5.5, 8.0]}], {"first": {"axes": [3, 5.5, 8]}, "unique": {"axes": [3, 5.5, 8]}, "same": {"axes": [3, 5.5, 8]}, "only": {}}),
    ([{"kept": {"x": True}, "mode": "fast"}, {"kept": {"x": True}, "mode": 4}], {"same": {"kept": {"x": True}}, "unique": {"kept": {"x": True}}}),
]


@pytest.mark.parametrize("case", range(len(NESTED)))
def test_nested(spark, case):
    inputs, expected = NESTED[case]
    tagged = nested.union(*[nested.from_dict(spark, d).withColumn("ds", F.lit(i)) for i, d in enumerate(inputs)])
    for strategy, result in expected.items():
        assert nested.to_dict(nested.merge(tagged, len(inputs), strategy)) == result, strategy
    assert nested.to_dict(nested.merge(tagged, len(inputs), None)) == {}


def test_large_integers_are_not_rounded(spark):
    from labelmx.operators.compare import differing_columns
    from labelmx.operators.nested import comparable

    one = small_table(spark, [("p", 2**53, 2, True)], "name string, big bigint, small bigint, flag boolean")
    two = small_table(spark, [("p", 2**53 + 1, 2.0, True)], "name string, big bigint, small double, flag boolean")
    target = one.select("name")
    assert differing_columns([(0, one), (1, two)], target, ["big", "small", "flag"]) == {"big"}
    texts = [str(2**53), str(2**53 + 1), "2", "2.0", "[1, 2.0]", "[1.0, 2]", "NaN", "true"]
    got = [r[0] for r in small_table(spark, [(i, t) for i, t in enumerate(texts)], "i int, value string").sort("i").select(comparable(F.col("value"))).collect()]
    assert got[0] != got[1] and got[2] == got[3] and got[4] == got[5] and got[6] is None and got[7] == "1"
