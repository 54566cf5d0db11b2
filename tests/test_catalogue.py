"""Every catalogue query with SQL against DuckDB on the smallest tables."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

from strandline.plans import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{name}'")
    return c


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    df = df.apply(lambda c: c.map(lambda x: None if x is None or x != x else (round(float(x), 6) if isinstance(x, float) else str(x))))
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(got), normal(want))


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_shuffled_sequences_equal_brute_force(spark, con):
    from strandline.plans.inputs import SEQS

    seqs = con.sql(SEQS).df()
    want = {}
    for u, seq in zip(seqs["user"], seqs["seq"], strict=True):
        order = sorted(range(len(seq)), key=lambda i: (hashlib.md5(f"2024|{u}|{i}|{seq[i]}".encode()).hexdigest(), i))  # noqa: B023
        want[u] = [str(seq[i]) for i in order]
    got = {r["user"]: r["items"].split(" ") for r in catalogue.queries()["shuffled_sequences"](spark, SF).collect()}
    assert got == want and any(got[u] != [str(t) for t in seq] for u, seq in zip(seqs["user"], seqs["seq"], strict=True))
