import pytest

from quillgraph.plans import registry
from tests.oracle import SF_DIR, connection, same_rows


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same_rows(registry.QUERIES[name](spark, SF_DIR), con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    rows = [str(r) for r in df.collect()]
    assert df.columns and len(rows) == len(set(rows))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
