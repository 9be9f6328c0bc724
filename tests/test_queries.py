"""Every registered query with SQL gives the rows that DuckDB gives; the others run and have rows."""

import pytest

from quillmill import registry

from .conftest import SF, plain, rows_of

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert rows_of(df) == expected
