"""Every registered query of the catalogue against its DuckDB equivalent."""

import math

import duckdb
import pytest

from shelfwise import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    found = duck.execute(registry.ORACLE_SQL[name])
    names, want = normal([c[0] for c in found.description], found.fetchall())
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == (names, want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_no_python_or_cross_join_where_sql_says_the_same(spark):
    for name in ("dup_keepers", "episode_dedupe_conditional", "missing_ranges", "season_status", "rollback_plan", "confidence_rubric", "episode_parse", "url_path_rollup"):
        plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "NestedLoop")), name
