"""Every query with SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest


from tercet.plans.registry import ORACLES, QUERIES


SMALL = "/root/testdata/sf0.001"


def rows(found):
    return sorted(tuple("nan" if isinstance(v, float) and v != v else repr(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    wanted = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    order = sorted(got.columns)
    assert rows(got.select(*order).collect()) == rows(wanted.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
