"""What the two passes of the audit hand on."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strandline.llm import divergence


def test_terms_meet_in_one_shuffle_and_go_on_as_numbers(spark, monkeypatch, tmp_path):
    rows = [(f"{'a b ' * (k % 3)}c{k % 5} B", "en" if k % 2 else "fr", f"s{k % 4}") for k in range(60)]
    spark.createDataFrame(rows, "text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    plans, columns, keep = {}, {}, divergence.stored

    def stored(df, name):
        plans[name], columns[name] = df._jdf.queryExecution().optimizedPlan().toString(), set(df.columns)
        return keep(df, name)

    monkeypatch.setattr(divergence, "stored", stored)
    assert divergence.audit(spark.read.parquet(str(tmp_path / "d")), 2).count() > 0
    assert {name for name, cols in columns.items() if "term" in cols} == {"split-terms"}
    assert not any(x in plans["split-terms"] for x in ("Join", "Aggregate")) and plans["split-terms"].count("MapInArrow") == 1


def test_numbers_of_rows_follow_the_order_of_the_texts(monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    texts = ["b a b", "c a", "d e f", "a"]
    table = pa.table({"split": pa.array([2] * 4, pa.int32()), "lang": ["en"] * 4, "text": pa.array([t.encode() for t in texts], pa.binary())})
    rows = [r for b in divergence._frequencies(iter(table.to_batches())) for r in b.to_pylist()]
    assert [(r["term"], r["n"]) for r in rows] == [("b", 1), ("a", 2), ("c", 1), ("d", 1), ("e", 1), ("f", 1), ("a", 1)]
    assert [r["row"] for r in rows] == [(2 << 36) + k for k in range(len(rows))]


def test_a_term_handed_on_twice_counts_once():
    known = [("a", 7), ("b", 8), ("a", 7)]
    rows = [(0, "en", None, None, t, k) for t, k in known] + [(0, "en", "s", x, None, None) for x in (b"a a b", b"A,c")] + [(0, "en", "t", b"b", None, None)]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    names = ["split", "lang", "source", "text", "term", "id"]
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    got = Counter()
    for b in divergence._occurrences(iter(table.to_batches(max_chunksize=2))):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["id"]] += r["n"]
    assert got == {("en", "s", 7): 3, ("en", "s", 8): 1, ("en", "t", 8): 1}


def test_shares_are_exact_on_both_sides_of_what_fits_a_long(spark):
    most = divergence.MOST_SMALL
    rows = [(n, t, v) for n in (0, 1, most - 1, most, most + 1, 10**17) for t, v in ((10**18, 3), (n + 1, 7), (n, 0))]
    out = spark.createDataFrame(rows, "n long, total long, v long").select("n", "total", "v", divergence._share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    for n, t, v, p in out.collect():
        assert p == (1 + 10**9 * (n + 2) // (t + 2 * v) if v else None)
