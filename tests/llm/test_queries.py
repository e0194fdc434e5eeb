"""Every registered query of the subpackage, against SQL where there is any, on the smallest tables."""

import pytest

from cuespark.llm.queries import ORACLES, QUERIES
from tests.test_queries import compare, database, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):  # noqa: F811
    compare(spark, database, name, QUERIES[name], ORACLES.get(name))
