"""Every query with SQL gives what DuckDB gives, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliant import registry

registry.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, oracle, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name in registry.ORACLE_SQL:
        found = oracle.execute(registry.ORACLE_SQL[name])
        named = [c[0] for c in found.description]
        assert sorted(named) == columns
        assert plain(rows) == plain(tuple(r[named.index(c)] for c in columns) for r in found.fetchall())
    else:
        assert rows


def test_the_rest_does_not_use_the_llm_subpackage():
    top = os.path.dirname(registry.__file__)
    for path in glob.glob(f"{top}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "foliant.llm" not in open(path).read(), path
