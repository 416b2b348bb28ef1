"""Every registered core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings code_chunks files repos index_stats push_events reading_labels chunker_config context_windows".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in result.fetchall())
    assert got == want


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_without_sql_run(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
