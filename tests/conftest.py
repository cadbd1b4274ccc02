import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from labelmx import LabeledMatrix, Matrix  # noqa: E402
from labelmx.plans.local import small_table  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("labelmx-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.wholeStage", "false")  # tiny inputs: compiling costs more than running
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1 -XX:+UseParallelGC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Labeled matrix from nested lists; ``None`` cells are absent."""
    def build(values, obs, var, *, sparse=False, obs_cols=None, var_cols=None, **slots):
        def axis(names, cols):
            cols = cols or {}
            kinds = {int: "bigint", float: "double", str: "string"}
            schema = "key bigint, ord bigint, name string"
            for c, v in cols.items():
                schema += f", {c} {kinds[type(next(x for x in v if x is not None))]}"
            rows = [(10 * i + 3, i, n, *[v[i] for v in cols.values()]) for i, n in enumerate(names)]
            return small_table(spark, rows, schema)

        def matrix(vals, is_sparse):
            cells = [
                (10 * i + 3, 10 * j + 3, float(v)) for i, row in enumerate(vals) for j, v in enumerate(row)
                if v is not None and not (is_sparse and v == 0)
            ]
            return Matrix(small_table(spark, cells, "obs_key bigint, var_key bigint, value double"), 0.0 if is_sparse else math.nan)

        layers = {k: matrix(v, sparse) for k, v in slots.pop("layers", {}).items()}
        X = None if values is None else matrix(values, sparse)
        return LabeledMatrix(axis(obs, obs_cols), axis(var, var_cols), X, layers=layers, obs_dense=True, var_dense=True, **slots)

    return build
