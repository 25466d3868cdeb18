"""Every registered query with SQL gives the rows of that SQL."""

import pytest

from keyloom.plans import catalog
from tests.conftest import SF


def plain(v):
    return repr(v) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    want = duck.sql(catalog.SQL[name])
    at = [list(want.columns).index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
