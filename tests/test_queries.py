"""Every registered query of the library against its SQL on the smallest given tables."""

import math
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

from labelmx.catalog import ORACLES, QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def given():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return con


def plain(value):
    """A value that compares and sorts alike on both sides."""
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return int(value) if isinstance(value, bool) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(v[i]) for i in order] for v in values), key=repr)


@pytest.fixture(scope="module")
def results(spark):
    """All queries, some at a time: most of them are many small jobs."""
    def run(name):
        df = QUERIES[name](spark, str(TABLES))
        return df.columns, df.collect()

    with ThreadPoolExecutor(2) as pool:
        yield {name: pool.submit(run, name) for name in sorted(ORACLES)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(results, given, name):
    columns, got = results[name].result()
    want = given.execute(ORACLES[name])
    titles = [c[0] for c in want.description]
    assert sorted(columns) == sorted(titles)
    assert rows(columns, got) == rows(titles, want.fetchall())


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
