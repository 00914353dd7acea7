import os
import sys

import pytest
from helpers import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from compare import duck, spark_rows  # noqa: E402

from pagemill.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck(SF, queries.ORACLE_SQL[name])
