"""Every query of the reference's operators against its SQL."""

import pytest
from oracle import same

from epiframe.plans.oracles import SQL
from epiframe.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(SQL)))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry_imports_without_a_session():
    import __spark_entry__

    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["event_id", "step", "x", "y"] and df.count() > 0
