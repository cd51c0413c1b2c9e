import pytest

from tests.oracle_check import compare, connect
from trainscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) is None
