"""Examples are slices of a user's own sequence: no row for each item of each window."""

import datetime

import pytest

from strandline.plans import merging


def tables(spark, d):
    """Two users; of their items 3 is no part."""
    bought = {1: [1, 2, 3, 4, 5, 6, 7], 2: [2, 3]}
    orders = [(u * 100 + k, u, datetime.datetime(2020, 1, 1 + k)) for u, s in bought.items() for k in range(len(s))]
    lines = [(u * 100 + k, item, 1, 1) for u, s in bought.items() for k, item in enumerate(s)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, k % 3) for k in (1, 2, 4, 5, 6, 7)], "p_partkey long, p_size int").write.parquet(f"{d}/part.parquet")
    return str(d)


@pytest.mark.parametrize("query", [merging.model_examples, merging.train_examples])
def test_examples_are_slices(spark, tmp_path, capsys, query):
    out = query(spark, tables(spark, tmp_path))
    out.explain()
    plan = capsys.readouterr().out
    assert "posexplode" not in plan and plan.count("collect_list") <= 3
    rows = out.collect()
    # the target of the second user is no part; of the first one's four prefixes without the last two items the one that ends with 3
    assert len(rows) == (1 if query is merging.model_examples else 3) and {r["user"] for r in rows} == {1}
    assert all(r["labels"].count("-100") == 0 for r in rows)
