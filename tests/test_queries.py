"""Every query of the engine against its SQL, or for those without, that it runs and is not empty."""

import pytest

from rastertime.plans import catalog
from tests.compare import same
from tests.conftest import SF

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.count() > 0
    assert len(set(out.columns)) == len(out.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
