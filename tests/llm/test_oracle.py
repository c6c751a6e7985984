import pytest

from __spark_entry__ import oracle_sql, queries
from tallyfold.llm.queries import ORACLE, QUERIES
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) and "pipeline" in queries()
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare(queries()[name](spark, SF), connect(SF), ORACLE[name]) == ""
