import pytest

from frameloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(name, same_as_sql):
    assert name in registry.ORACLES
    same_as_sql(registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"a", "b", "similarity", "spread"}
