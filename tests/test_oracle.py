"""Every registered query against its DuckDB oracle on the sf0.001 data set."""

import pytest

from tests.harness import check, duck
from tidemark.plans.registry import load_all

SF = "/root/testdata/sf0.001"
NAMES = sorted(load_all())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = check(spark, name, SF, con)
    assert ok is not False, msg


def test_entry_contract(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert "user_id" in df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
