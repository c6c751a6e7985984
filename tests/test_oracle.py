import pytest

from __spark_entry__ import oracle_sql, queries
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
TWINS = oracle_sql()
# model fits take seconds each; they are compared by tests/check_oracle.py and covered by test_learning and test_job
FITS = ("l1_", "l5_", "l6_", "l8_", "s11_")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(queries())


@pytest.mark.parametrize("name", [n for n in TWINS if not n.startswith(FITS)])
def test_same_rows_as_sql(spark, con, name):
    assert compare(queries()[name](spark, SF), con, TWINS[name]) == ""
