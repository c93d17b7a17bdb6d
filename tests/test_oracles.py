import pytest

from quillon import catalog

from .conftest import DATA, rows

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, duck, name):
    got, want = catalog.queries()[name](spark, f"{DATA}/sf0.001").toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(catalog.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES)))
def test_others_run(spark, name):
    got = catalog.queries()[name](spark, f"{DATA}/sf0.001").toPandas()
    assert len(got) and ("mismatches" not in got or not got["mismatches"].any())
