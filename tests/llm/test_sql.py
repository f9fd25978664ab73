"""Training-data queries that SQL can express, against that SQL."""

import pytest
from oracle import same

from epiframe.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)
