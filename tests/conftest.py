import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent
sys.path[:0] = [str(ROOT), str(ROOT.parent)]

from crowdread.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named string columns."""

    def value(expression, **columns):
        names = list(columns) or ["x"]
        schema = ", ".join(f"{n} {kind(columns.get(n))}" for n in names)
        df = spark.createDataFrame([tuple(columns.get(n) for n in names)], schema)
        return df.select(expression.alias("v")).first()["v"]

    return value


def kind(value):
    if isinstance(value, bool):
        return "boolean"
    return {int: "bigint", float: "double"}.get(type(value), "string")
