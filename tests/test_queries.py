"""Every registered query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pytest

from tessera.plans import programs, registry, rollouts, sources, texts  # noqa: F401
from tests.support import difference

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(registry.QUERIES[name](spark, DATA), duck.sql(registry.SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["harness_score", "rollout_loop", "rsa_loop", "budget_loop"])
def test_programs_take_every_part(spark, duck, name):
    got = {r[0] for r in registry.QUERIES[name](spark, DATA).select("problem_id").distinct().collect()}
    assert got == {r[0] for r in duck.sql("SELECT p_partkey FROM part").fetchall()}


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "prefix_curve" in e.queries()
