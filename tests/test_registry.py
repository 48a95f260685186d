"""Registry queries against DuckDB on the smallest tables."""

import duckdb
import pytest

from quillon import registry, registry_store

SAMPLE = sorted(registry.PLAIN) + ["insert_select", "upsert_update", "upsert_duplicate_key", "update", "returning", "timestamp_codec", "bool_codec", "json_codec", "repo_fetch_by_key"]
SAMPLE += sorted(registry_store.STORE)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in registry.NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
@pytest.mark.filterwarnings("ignore:a join without")
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    cur = duck.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})")
    assert got == sorted(map(tuple, cur.fetchall()), key=str)
