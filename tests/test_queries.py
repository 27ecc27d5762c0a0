"""Every registered query against its SQL form."""

import pytest

import __spark_entry__ as contract
from check_queries import compare, connect

CHECKED = sorted(contract.oracle_sql())


@pytest.fixture(scope="session")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_equal_to_sql(spark, con, sf, name):
    verdict, _ = compare(spark, con, name, sf)
    assert verdict.startswith("equal") and "TYPES" not in verdict, verdict


def test_every_sql_has_a_query():
    assert set(CHECKED) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    # Twenty invented texts a video form no dense group; topics of a report are tested with planted ones.
    assert len(rows) == 20 and all(r.topics is not None for r in rows)
