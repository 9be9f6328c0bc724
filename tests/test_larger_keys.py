"""Queries and their SQL on rows that the small tables lack: longer numbers, and ids that don't follow time."""

import duckdb
import pytest

from quillmill import registry

from .conftest import SF, plain, rows_of


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("larger")
    con = duckdb.connect()
    events = f"read_parquet('{SF}/events.parquet')"
    con.execute(f"COPY (SELECT * FROM {events} UNION ALL SELECT * REPLACE (event_id + 100000 AS event_id) FROM {events} UNION ALL SELECT * REPLACE (event_id + 200000 AS event_id, user_id + 1990 AS user_id) FROM {events}) TO '{path}/events.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT i AS doc_id, 'en' AS lang, 's' AS source, 'text' AS text FROM range(10100) AS r(i)) TO '{path}/documents.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("name", ["f14_normalize_expression", "st5_failure_breaker", "e19_degrade_after_failures", "c12_chunk_id"])
def test_query(name, spark, folder):
    duck = duckdb.connect()
    for t in ("events", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = registry.queries()[name](spark, folder)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall()), key=repr)
    assert rows_of(df) == expected
