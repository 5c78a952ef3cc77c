"""Registered queries against their SQL in DuckDB on the smallest tables."""
import pytest

from tessera.plans import catalog
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.oracle_sql())
KERNELS = ("grf_16_min_matching", "opt_15_branch_and_bound", "geo_16_simplify", "stm_05_day_replay")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, con, name):
    said = check(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF)
    assert said in (None, "no rows"), said


@pytest.mark.parametrize("name", KERNELS)
def test_kernels_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
