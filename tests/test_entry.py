import os

import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user", "items", "n"] and df.count() > 0
