"""Every registered query against its SQL, and a rows check for the others."""

import pytest

from takeup.plans import compare
from takeup.plans.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare.differences(got, duck.execute(ORACLE[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if "score" in got.columns:
        assert got["score"].between(0, 1).all()
        assert not got.duplicated(["customer_id", "target", "fold"]).any()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
