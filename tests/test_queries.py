"""Every query outside the subpackage against its SQL."""

import pytest

from siftlane.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_sql(spark, data, duck, same, name):
    same(catalogue.QUERIES[name](spark, data), duck.sql(catalogue.SQL[name]))


def test_signatures_have_a_row_a_ban(spark, data):
    rows = catalogue.QUERIES["vector_signatures"](spark, data).collect()
    assert rows and len({r.id for r in rows}) == len(rows) and all(len(r.signature) == 64 for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
