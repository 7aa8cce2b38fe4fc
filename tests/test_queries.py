"""Every query against its SQL, and those without SQL against having rows and a stable schema."""

import pytest

from compare import rows
from fathomline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    got = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert rows(got.toPandas()) == rows(duck.sql(SQL[name]).df())
    else:
        frame = got.toPandas()
        assert list(frame.columns) == got.columns
        assert len(frame)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
