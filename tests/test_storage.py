"""Categories, text sources, bundles and streams."""
import math
import warnings

import pytest
from pyspark.sql import functions as F

from labelmx import Categories, Graph, Matrix, Table, Vectors, concat, from_wide
from labelmx.operators import build as B
from labelmx.operators import categories as C
from labelmx.operators import names as N
from labelmx.operators import nested
from labelmx.operators import reshape as R
from labelmx.catalog.sources import _write_lines
from labelmx.model import Raw
from labelmx.operators.update import materialize, snapshot_raw
from labelmx.plans.local import small_table
from labelmx.sources import bundle, text
from labelmx.sources.csv_dir import write_csvs
from labelmx.streaming import append_stream, chunk_stream

from helpers import column, grid, names


def test_dictionaries(spark, make):
    shade = ["red", None, "teal", "red", "teal", "red", "grey"]
    lm = make(None, [f"car{i}" for i in range(7)], ["v"], obs_cols={"shade": shade, "plate": [f"K-{i}" for i in range(7)], "doors": [2, 4] * 3 + [4]})
    out = C.strings_to_categories(lm)
    assert list(out.obs_categories) == ["shade"]  # plates never repeat, doors are no text
    known = out.obs_categories["shade"]
    order = [r.category for r in known.table.orderBy("code").collect()]
    assert order == sorted(set(shade) - {None})
    coded = C.encode_categories(lm.obs, "shade", known)
    assert [r.shade for r in coded.orderBy("ord").collect()] == [order.index(x) if x else -1 for x in shade]
    assert [r.shade for r in C.decode_categories(coded, "shade", known).orderBy("ord").collect()] == shade
    short = Categories(small_table(spark, [(0, "grey"), (1, "red")], "code int, category string"))
    assert C.decode_categories(coded, "shade", short).schema["shade"].dataType.simpleString() == "int"


def test_natural_order(spark):
    values = ["a10", "b", "2", "a2", "10", "a", "ab", "a02"]
    cats = C.dictionary(small_table(spark, [(v,) for v in values], "c string"), "c")
    assert [r.category for r in cats.table.orderBy("code").collect()] == ["2", "10", "a", "a02", "a2", "a10", "ab", "b"]


def test_rename(spark, make):
    lm = make(None, [f"w{i}" for i in range(5)], ["g"], obs_cols={"wine": ["dry", "sweet", "dry", "dry", "sweet"]})
    notes = {"score": {"params": {"groupby": "wine"}, "mean": {"dry": [6.5, 7], "sweet": [4]}, "half": {"dry": 1}}, "free": {"mean": {"dry": 0, "sweet": 0}}}
    lm = C.strings_to_categories(lm).replace(uns=nested.from_dict(spark, notes))
    out = C.rename_categories(lm, "obs", "wine", ["brut", "doux"])
    assert column(out, "obs", "wine") == ["brut", "doux", "brut", "brut", "doux"]
    # fields named by all categories follow, beside parameters that name the column; others stay
    notes["score"]["mean"] = {"brut": [6.5, 7], "doux": [4]}
    assert nested.to_dict(out.uns) == notes
    for bad in ({"dry": "brut"}, ["one of two"]):
        with pytest.raises(ValueError):
            C.rename_categories(lm, "obs", "wine", bad)
    with pytest.raises(ValueError):
        C.rename_categories(lm, "obs", "beer", ["brut", "doux"])


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


GAUGES = [[2.5, -1.0], [0.0, 7.0], [4.0, 1e3]]


def gauge_text(sep, first=None, quote=""):
    """Lines of ``GAUGES``, with a name in front of each if given."""
    lead = first or [None] * len(GAUGES)
    return "".join(sep.join([*([f"{quote}{n}{quote}"] if n else []), *map(str, r)]) + "\n" for n, r in zip(lead, GAUGES))


TEXTS = [  # content, delimiter, names asked for, obs names, var names
    ("well;level;flow\n" + gauge_text(";", ["w1", "w2", "w3"]), ";", None, ["w1", "w2", "w3"], ["level", "flow"]),
    ("# gauges of May\n# level flow\n" + gauge_text("\t", ["w1", "w2", "w3"]).replace("w3", "\nw3"), "\t", None, ["w1", "w2", "w3"], ["level", "flow"]),
    (gauge_text("    ").replace("\n", "  \n"), None, None, ["0", "1", "2"], ["0", "1"]),
    ("1995 1996\n" + gauge_text(" ", ["31", "32", "33"]), None, None, ["31", "32", "33"], ["1995", "1996"]),
    ('"level","flow"\n' + gauge_text(","), ",", None, ["0", "1", "2"], ["level", "flow"]),
    ("well,level,flow\n" + gauge_text(",", ["5", "6", "7"], '"'), ",", True, ["5", "6", "7"], ["level", "flow"]),
]


@pytest.mark.parametrize("case", range(len(TEXTS)))
def test_text(spark, tmp_path, case):
    content, delimiter, asked, obs, var = TEXTS[case]
    lm = text.read_text(spark, put(tmp_path, "m.txt", content), delimiter, asked)
    assert (names(lm, "obs"), names(lm, "var")) == (obs, var)
    assert grid(lm) == GAUGES


def test_text_in_many_splits(spark, tmp_path):
    rows = [[i, i * 7 % 11, 0.5] for i in range(400)]
    path = put(tmp_path, "big.csv", "\n".join(["a,b,c", *[",".join(map(str, r)) for r in rows]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() > 5
        assert grid(text.read_csv(spark, path)) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_text_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="delimiter"):
        text.read_csv(spark, put(tmp_path, "a.txt", "1 2\n3 4\n"))
    ragged = text.read_csv(spark, put(tmp_path, "b.csv", "a,b\n1,2\n3,4\n5\n"))
    with pytest.raises(Exception, match="the first row has"):
        ragged.X.cells.collect()


def test_counts_and_market_files(spark, tmp_path):
    umi = put(tmp_path, "u.tsv", "gene\tcell\tcount\ng2\tc1\t3\ng1\tc1\t1\ng2\tc2\t5\ng2\tc1\t4\n")
    lm = text.read_umi_counts(spark, umi)
    assert (names(lm, "obs"), names(lm, "var"), grid(lm)) == (["c1", "c2"], ["g2", "g1"], [[4, 1], [5, 0]])
    assert text.read_umi_counts(spark, umi, dense=True).X.cells.count() == 4
    head = "%%MatrixMarket matrix coordinate {}\n% note\n3 3 {}\n"
    assert grid(text.read_mtx(spark, put(tmp_path, "g.mtx", head.format("real general", 3) + "1 1 2.5\n3 3 3\n2 1 4\n"))) == [[2.5, 0, 0], [4, 0, 0], [0, 0, 3]]
    assert grid(text.read_mtx(spark, put(tmp_path, "s.mtx", head.format("integer symmetric", 2) + "1 1 2\n3 1 4\n"))) == [[2, 0, 4], [0, 0, 0], [4, 0, 0]]
    assert grid(text.read_mtx(spark, put(tmp_path, "p.mtx", head.format("pattern general", 2) + "1 2\n2 3\n"))) == [[0, 1, 0], [0, 0, 1], [0, 0, 0]]
    assert grid(text.read_mtx(spark, put(tmp_path, "a.mtx", "%%MatrixMarket matrix array real general\n2 2\n1\n2\n0\n4\n"))) == [[1, 0], [2, 4]]


@pytest.fixture
def full(spark, make):
    lm = make([[1, 0, 2], [0, 0, 3]], ["r1", "r2"], list("abc"), sparse=True, obs_cols={"k": ["x", "x"], "v": [1.5, None]}, layers={"two": [[2, 0, 4], [0, 0, 6]]})
    vec = Vectors(lm.obs.select("key", F.array(F.col("ord").cast("double"), F.lit(1.0)).alias("vec")), 2)
    graph = Graph(small_table(spark, [(3, 13, 1.0)], "i_key bigint, j_key bigint, value double"))
    lm = lm.replace(obsm={"p": vec, "t": Table(lm.obs.select("key", "name"))}, obsp={"g": graph}, uns=nested.from_dict(spark, {"a": {"b": [1, 2]}, "none": None}))
    return snapshot_raw(lm, lm)


def test_bundle_round_trip(spark, full, tmp_path):
    path = str(tmp_path / "b")
    bundle.write_bundle(full, path)
    got = bundle.read_bundle(spark, path)
    assert grid(got) == grid(full) and grid(got, got.layers["two"]) == [[2, 0, 4], [0, 0, 6]]
    assert names(got, "obs") == ["r1", "r2"] and column(got, "obs", "v") == [1.5, None] and got.obs_dense
    assert [r.category for r in got.obs_categories["k"].table.collect()] == ["x"]
    assert nested.to_dict(got.uns) == {"a": {"b": [1, 2]}}
    assert got.obsp["g"].edges.count() == 1 and got.obsm["t"].columns == ["name"] and got.raw.X.cells.count() == 3
    assert bundle.stored_shape(spark, path) == (2, 3)
    again = materialize(got)
    assert grid(again) == grid(full)
    # a stored matrix can be replaced by its own subset
    bundle.write_bundle(got[["r2"]], path)
    assert grid(bundle.read_bundle(spark, path)) == [[0, 0, 3]]


def test_bundle_options(spark, full, make, tmp_path):
    dense = str(tmp_path / "d")
    bundle.write_bundle(full, dense, as_dense=["X", "raw/X"], compression="gzip", compression_level=9)
    got = bundle.read_bundle(spark, dense)
    assert got.X.cells.count() == 6 and got.raw.X.cells.count() == 6 and not got.X.sparse
    assert R.read_as_sparse(got, ["X", "raw/X"]).X.cells.count() == 3
    with pytest.raises(NotImplementedError):
        bundle.write_bundle(full, str(tmp_path / "e"), as_dense=["layers"])
    with pytest.raises(NotImplementedError):
        R.read_as_sparse(got, ["obs"])
    with pytest.raises(ValueError):
        bundle.write_bundle(full.replace(raw=None), str(tmp_path / "e"), as_dense=["raw/X"])
    with pytest.raises(ValueError, match="_index"):
        bundle.write_bundle(full.replace(obs=full.obs.withColumn("_index", F.lit(1))), str(tmp_path / "e"))
    blocks = str(tmp_path / "blocks")
    bundle.write_bundle(full, blocks, chunks=(1, 2))
    assert grid(bundle.read_bundle(spark, blocks)) == grid(full)
    plan = bundle.read_bundle(spark, dense).X.cells.where("obs_key = 3").select("value")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(obs_key), EqualTo(obs_key,3)]" in plan


def test_append(spark, make, tmp_path):
    path = str(tmp_path / "a")
    base = make([[1, 0], [0, 2]], ["a", "b"], ["x", "y"], sparse=True)
    bundle.write_bundle(base, path)
    more = make([[5, 6]], ["c"], ["y", "x"], sparse=True)  # same names in another order
    assert bundle.append(spark, path, more, stream="s", batch=0)
    assert not bundle.append(spark, path, more, stream="s", batch=0)
    got = bundle.read_bundle(spark, path)
    assert names(got, "obs") == ["a", "b", "c"] and grid(got) == [[1, 0], [0, 2], [6, 5]]
    for wrong in (make([[1, 2, 3]], ["d"], ["x", "y", "z"], sparse=True), make([[1, 2]], ["d"], ["x", "q"], sparse=True), make([[1, 2]], ["d"], ["x", "y"])):
        with pytest.raises(ValueError):
            bundle.append(spark, path, wrong)
    with pytest.raises(ValueError, match="layout"):
        bundle.append(spark, path, make([[1], [2], [3]], ["a", "b", "c"], ["z"], sparse=True), axis="var")
    assert bundle.stored_shape(spark, path) == (3, 2)


def test_append_grows_categories_and_raw(spark, make, tmp_path):
    path = str(tmp_path / "a")
    kinds = F.create_map(*[F.lit(x) for x in "aubucbduea"])  # a, b and d are u, c is b, e is a
    kind = lambda lm: lm.replace(obs=lm.obs.withColumn("kind", kinds[F.col("name")]))
    frozen = make([[7, 0, 1], [0, 8, 0]], ["a", "b"], ["x", "y", "z"], sparse=True)
    bundle.write_bundle(kind(make([[1, 0], [0, 2]], ["a", "b"], ["x", "y"], sparse=True)).replace(raw=Raw(frozen.X, frozen.var)), path)
    more = kind(make([[5, 6], [0, 1], [1, 1]], ["c", "d", "e"], ["x", "y"], sparse=True))
    with pytest.raises(ValueError, match="raw"):
        bundle.append(spark, path, more)
    late = make([[3, 4, 0], [0, 0, 9], [0, 0, 0]], ["c", "d", "e"], ["z", "y", "x"], sparse=True)  # same names in another order
    assert bundle.append(spark, path, more.replace(raw=Raw(late.X, late.var)))
    got = bundle.read_bundle(spark, path)
    cats = got.obs_categories["kind"]
    assert sorted(map(tuple, cats.table.collect())) == [(0, "u"), (1, "a"), (2, "b")] and cats.size == 3
    assert [r.kind for r in C.encode_categories(got.obs, "kind", cats).orderBy("ord").collect()] == [0, 0, 2, 0, 1]
    place = lambda t, k: t.select(F.col("key").alias(k), F.col("name").alias(k[:3]))
    cells = got.raw.X.cells.join(place(got.obs, "obs_key"), "obs_key").join(place(got.raw.var, "var_key"), "var_key").where("value <> 0")
    assert {(r.obs, r["var"], r.value) for r in cells.collect()} == {("a", "x", 7), ("a", "z", 1), ("b", "y", 8), ("c", "z", 3), ("c", "y", 4), ("d", "x", 9)}


def test_csv_directory(spark, full, tmp_path):
    path = str(tmp_path / "out.csv")
    with pytest.warns(UserWarning, match="sparse"):
        write_csvs(full.replace(obsm={"p": full.obsm["p"]}), path, skip_data=False, graphs_in_uns=full.obsp)
    root = path[:-4]
    assert [r.value for r in spark.read.text(f"{root}/X.csv").collect()] == ["1.0,0.0,2.0", "0.0,0.0,3.0"]
    assert spark.read.csv(f"{root}/obsm.csv", header=True).columns == ["p1", "p2"]
    assert spark.read.csv(f"{root}/obs.csv", header=True).count() == 2
    assert spark.read.csv(f"{root}/uns/a.csv").first()[0] == "b"


def test_builders(spark, make):
    wide = small_table(spark, [("r1", 1, 0.5), ("r2", 2, 0.0)], "n string, x bigint, y double")
    assert grid(from_wide(wide, name="n")) == [[1, 0.5], [2, 0]]
    assert from_wide(wide, name="n", sparse=True).X.cells.count() == 3
    data = small_table(spark, [(0, 1, 5.0), (1, 0, 6.0), (2, 2, 7.0)], "pos bigint, index bigint, value double")
    indptr = small_table(spark, [(0, 0, 1), (1, 1, 1), (2, 1, 3)], "major bigint, start bigint, end bigint")
    assert grid(B.from_compressed(data, indptr, (3, 3))) == [[0, 5, 0], [0, 0, 0], [6, 0, 7]]
    assert grid(B.from_compressed(data, indptr, (3, 3), by_rows=False)) == [[0, 0, 6], [5, 0, 0], [0, 0, 7]]
    with pytest.raises(TypeError):
        B.from_struct(wide, "x")
    lm = make(None, ["a", "b"], ["v"], obs_cols={"p": [1, 2], "q": [3, 4], "same": ["z", "z"]})
    out = B.assemble_vectors(lm, "obs", "pq", ["p", "q"])
    assert [r.pq2 for r in B.flatten_vectors(out, "obs").orderBy("name").collect()] == [3, 4] and "p" not in out.obs.columns
    less = B.collapse_constant_columns(lm, "obs")
    assert "same" not in less.obs.columns and nested.to_dict(less.uns) == {"table-obs": {"same": "z"}}
    table = small_table(spark, [(0, "u"), (1, "w")], "i bigint, row_names string")
    assert [r.name for r in B.from_annotation(table, order="i").orderBy("ord").collect()] == ["u", "w"]
    assert [r.name for r in B.from_annotation(table.drop("row_names"), order="i").orderBy("ord").collect()] == ["0", "1"]
    with pytest.raises(ValueError):
        N.set_names(lm, "obs", small_table(spark, [(0, "u")], "pos bigint, name string"))
    with pytest.raises(ValueError, match="digit"):
        N.make_names_unique(lm, "obs", "-1")


def test_chunks_and_samples(make):
    import pandas as pd
    values = [[i, 2 * i, 0] for i in range(10)]
    lm = make(values, [f"o{i}" for i in range(10)], list("abc"), sparse=True)
    schema = "start bigint, end bigint, col bigint, total double"
    fn = lambda v, s, e, c: pd.DataFrame({"start": [s], "end": [e], "col": [c], "total": [float(v.sum())]})
    got = sorted(tuple(r) for r in R.map_chunks(lm, fn, schema, chunk_size=4).collect())
    assert got == [(0, 4, 0, 18.0), (4, 8, 0, 66.0), (8, 10, 0, 51.0)]
    tiles = R.map_chunks(lm, fn, schema, chunk_size=4, var_block=2).collect()
    assert len(tiles) == 6 and sum(r.total for r in tiles) == 135.0
    assert R.blocks_of(10, 4) == [(0, 4), (4, 8), (8, 10)]
    some = R.sample_rows(lm, 6, replace=False, seed=1)
    assert len(set(names(some, "obs"))) == 6 and all(r in values for r in grid(some))
    again = R.sample_rows(lm, 6, replace=False, seed=1)
    assert names(again, "obs") == names(some, "obs")
    assert R.sample_rows(lm, 50, seed=2).shape == (10, 3)


def test_streams(spark, make, tmp_path):
    import pandas as pd
    schema = "id bigint, col string, v double"
    rows = [(i, "x" if i % 3 else "y", float(i + 1)) for i in range(30)]
    src = str(tmp_path / "src")
    small_table(spark, rows, schema).repartition(3, "id").write.parquet(src)
    var = make(None, ["o"], ["x", "y"]).var

    def to_matrix(batch):
        from labelmx import axis_table, create
        obs = axis_table(batch.select("id"), key="id")
        cells = batch.select(F.col("id").alias("obs_key"), F.col("col").alias("var_name"), F.col("v").alias("value"))
        return create(cells, obs, var, dtype=None)

    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    path = str(tmp_path / "m")
    bundle.write_bundle(to_matrix(small_table(spark, [], schema)), path)
    for _ in range(2):  # the second start finds nothing new
        append_stream(read(), path, to_matrix, str(tmp_path / "ck")).awaitTermination()
    got = bundle.read_bundle(spark, path)
    assert got.shape == (30, 2) and got.X.cells.agg(F.sum("value")).first()[0] == sum(r[2] for r in rows)
    # a lost stream checkpoint replays all batches; none is added again
    append_stream(read(), path, to_matrix, str(tmp_path / "ck2")).awaitTermination()
    assert bundle.stored_shape(spark, path) == (30, 2)

    fn = lambda v, s, e, c: pd.DataFrame({"n": [int((v != 0).sum())], "t": [float(v.sum())]})
    out = str(tmp_path / "chunks")
    chunk_stream(read(), to_matrix, fn, "n bigint, t double", out, str(tmp_path / "ck3"), chunk_size=4).awaitTermination()
    total = spark.read.parquet(out).agg(F.sum("n"), F.sum("t")).first()
    assert tuple(total) == (30, 465.0)


def test_many_blocks_make_few_files(spark, make, tmp_path):
    """Files grow with the cells, not with the number of blocks (each block was a folder)."""
    lm = make([[float(30 * i + j + 1) for j in range(30)] for i in range(30)], [f"o{i}" for i in range(30)], [f"v{j}" for j in range(30)])
    path = str(tmp_path / "b")
    bundle.write_bundle(lm, path, chunks=(1, 1))
    entry = bundle.read_manifest(spark, path)["slots"]["X"]
    assert len(list((tmp_path / "b" / entry["segments"][0]).rglob("*.parquet"))) <= 4
    stored = spark.read.parquet(f"{path}/{entry['segments'][0]}")
    assert {(r.row_block, r.col_block): r.value for r in stored.collect()} == {(i, j): float(30 * i + j + 1) for i in range(30) for j in range(30)}
    assert grid(bundle.read_bundle(spark, path)) == grid(lm)


def test_lines_of_one_place_are_dealt(spark):
    """The body of a file in any order is sorted by many tasks, behind its head."""
    body = spark.range(5000).select(F.lit(1).cast("bigint").alias("at"), F.col("id").cast("string").alias("value"), "id")
    lines = small_table(spark, [(-1, "head")], "at bigint, value string").unionByName(body, allowMissingColumns=True)
    with_setting = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = _write_lines(lines, "dealt", "id")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_setting)
    read = spark.read.text(path)
    counts = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
    assert len(counts) == 2 and max(counts) < 4000 and sum(counts) == 5001
    assert read.orderBy(F.input_file_name(), F.monotonically_increasing_id()).first().value == "head"
