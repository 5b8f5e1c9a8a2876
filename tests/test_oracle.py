"""Every registered query against its SQL on the smallest tables."""

import pytest

import check_oracle
from wardline.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return check_oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    result = check_oracle.compare(spark, db, name, SF_DIR)
    assert result.startswith(("ok", "rows-only")), result


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns[:2] == ["class_id", "name"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
