"""Ranks, blocks and dense rows on their large-data paths, forced with small limits."""
import random

from pyspark.sql import functions as F

from labelmx.operators.names import unique_names
from labelmx.operators.reshape import densify, pack_cols, pack_rows, unpack
from labelmx.operators.update import constant_cells
from labelmx.plans.blocks import key_blocks, spread
from labelmx.plans.durable import cut, stored
from labelmx.plans.local import small_table
from labelmx.plans.ranks import numbered, ranked, running_total

from helpers import grid


def test_rank_over_many_buckets(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10**9), 3000)
    df = small_table(spark, [(k,) for k in keys], "k bigint")
    got = {r.k: r.pos for r in ranked(df, "k", "pos", rows_per_bucket=50).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_rank_of_text(spark):
    words = [f"n{i * 7919 % 2003:05d}" for i in range(2003)]
    df = small_table(spark, [(w,) for w in words], "w string")
    got = {r.w: r.pos for r in ranked(df, "w", "pos", rows_per_bucket=40).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_running_total_of_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(("hot" if rng.random() < 0.4 else f"g{rng.randrange(50)}"), i, rng.randrange(5)) for i in range(2000)]
    df = small_table(spark, rows, "g string, o bigint, v bigint")
    out = running_total(df, "o", F.col("v"), "t", ["g"], rows_per_bucket=60).collect()
    seen = {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + v
        assert next(r.t for r in out if r.o == o) == seen[g] if o % 97 == 0 else True
    assert len(out) == len(rows)


def test_number_along_several_columns(spark):
    """Equal first columns are cut between parts; ranks are whole and need no sort of all rows in a task."""
    rng = random.Random(4)
    rows = sorted({(rng.choice([5, 5, 5, rng.randrange(9)]), rng.randrange(10**6), "x") for _ in range(900)}, key=lambda r: (-r[0], r[1]))
    df = small_table(spark, rng.sample(rows, len(rows)), "a bigint, b bigint, t string")
    for parts in (1, 7, None):
        out = numbered(df, F.desc("a"), F.asc("b"), out="n", parts=parts)
        assert out.columns == ["a", "b", "t", "n"]
        assert [tuple(r) for r in out.orderBy("n").collect()] == [(*r, i) for i, r in enumerate(rows)]
    assert numbered(df.limit(0), "a").count() == 0


def test_ranks_with_null_groups(spark):
    rows = [(g, i) for i, g in enumerate([None, "a", None, "b", "a", None] * 9)]
    df = small_table(spark, rows, "g string, o bigint")
    got = {(r.g, r.o): r.pos for r in ranked(df, "o", "pos", ["g"], rows_per_bucket=5).collect()}
    assert got == {(g, o): sum(1 for h, p in rows if h == g and p < o) for g, o in rows}


def check_unique(before, after, join="-"):
    """First occurrences stay, all names differ, and each later one has the smallest number then free."""
    assert len(set(after)) == len(before) == len(after)
    for i, (old, new) in enumerate(zip(before, after)):
        if old not in before[:i]:
            assert new == old
        else:
            stem, _, number = new.rpartition(join)
            assert stem == old and number.isdigit()
            used = set(before) | set(after[:i])
            assert all(f"{old}{join}{k}" in used for k in range(1, int(number)))


def test_unique_names(spark):
    rng = random.Random(3)
    cases = [["red", "red", "red-1", "blue", "red-1"], ["p", "q"], ["k", "k-3", "k", "k", "k-1", "k", "k-1"]]
    cases += [[rng.choice(["a", "a", "a", "a-1", "a-2", "a-4", "b", "a-1-1", "b-2", "a-01"]) for _ in range(60)] for _ in range(2)]
    for values in cases:
        df = small_table(spark, [(i, i, v) for i, v in enumerate(values)], "key bigint, ord bigint, name string")
        for rpb in (None, 7):
            got = [r.name for r in unique_names(df, rows_per_bucket=rpb).orderBy("ord").collect()]
            check_unique(values, got)


def test_spread_without_broadcast(spark):
    axis = small_table(spark, [(k, k) for k in range(0, 90, 3)], "key bigint, ord bigint")
    rows = spark.range(40).toDF("obs_key")
    for limit in (0, 1000):
        grid_rows = spread(rows, key_blocks(axis, width=7), 30, width=7, broadcast_keys=limit, copies=5)
        pairs = grid_rows.select("obs_key", F.explode("keys").alias("k"))
        assert pairs.count() == 40 * 30 and pairs.distinct().count() == 40 * 30
    plan = spread(rows, key_blocks(axis, width=7), 30, width=7, broadcast_keys=0)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_blocks_stay_bounded(spark, make):
    values = [[(i * j) % 3 for j in range(11)] for i in range(5)]
    lm = make(values, [f"o{i}" for i in range(5)], [f"v{j}" for j in range(11)], sparse=True)
    for width in (1, 4, 11, 50):
        assert pack_rows(lm, width=width).where(F.size("packed") > width).isEmpty()
        assert grid(lm, unpack(lm, pack_rows(lm, width=width), width=width)) == values
        assert grid(lm, unpack(lm, pack_cols(lm, width=width), by_rows=False, width=width)) == values
        dense = {(r.obs_key, r.var_key): r.value for r in densify(lm, width=width).cells.collect()}
        assert dense == {(10 * i + 3, 10 * j + 3): values[i][j] for i in range(5) for j in range(11)}


def test_constant_cells(spark, make):
    lm = make(None, ["a", "b"], ["x", "y", "z"])
    assert constant_cells(lm.obs, lm.var, F.lit(2.0)).count() == 6


def test_cut_and_stored_keep_rows(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    assert cut(df).agg(F.sum("v")).first()[0] == 9900
    back = stored(df)
    assert back.agg(F.sum("v")).first()[0] == 9900 and back.columns == df.columns


def test_hot_row_is_split_in_selection(spark):
    """A third of all cells in one row: the join splits that partition."""
    from labelmx import Matrix, create, tune
    from labelmx.model import axis_table

    tune(spark)
    hot = spark.range(20_000).select(F.lit(7).cast("bigint").alias("obs_key"), F.col("id").alias("var_key"), F.lit(1.0).alias("value"))
    rest = spark.range(40_000).select((F.col("id") % 4000 + 10).alias("obs_key"), F.col("id").alias("var_key"), F.lit(2.0).alias("value"))
    cells = stored(hot.unionByName(rest).repartition(8))
    lm = create(None, axis_table(spark.range(5000), key="id"), axis_table(spark.range(40_000), key="id"), dtype=None).replace(X=Matrix(cells))
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB", "spark.sql.shuffle.partitions": "16",
    }
    old = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        kept = lm.subset(obs=F.col("key") < 4500).X.cells
        assert len(kept.collect()) == 60_000
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
