import pytest

from tests.oracle import same
from versetime.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)
