"""Every query of the catalogue against its SQL on the smallest tables."""

import pytest

from loomgrid.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=repr) == sorted(got.fetchall(), key=repr)


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
