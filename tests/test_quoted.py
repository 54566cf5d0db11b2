"""Records over line breaks, read in small splits, against Python's csv reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from strandline.sources import quoted as Q
from strandline.sources import records as R

SCHEMA = "a string, b string, c string"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def made(rng, n):
    words = ["x", "", "two words", "a,b", 'say "no"', "line\nbreak", "\n\n\n", "end\n", '"', "é 甲", "long " * 60, "many\n" * 40]
    return [[f"k{k}", rng.choice(words), rng.choice(words)] for k in range(n)]


def as_file(path, rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    path.write_text(out.getvalue(), encoding="utf-8")
    return out.getvalue()


@pytest.mark.parametrize("seed", range(3))
def test_records_in_many_tasks_equal_one_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    want = []
    (tmp_path / "in").mkdir()
    for name in ("one.csv", "two.csv"):
        rows = made(rng, 60)
        as_file(tmp_path / "in" / name, rows)
        want += [(name, *[x or None for x in r]) for r in rows]
    lines = Q._lines(spark, str(tmp_path / "in"))
    assert lines.select("file", "block").distinct().count() > 20
    got = Q.read_quoted(spark, str(tmp_path / "in"), SCHEMA)
    found = [(r["file"].rsplit("/", 1)[1], r["a"], r["b"] or None, r["c"] or None) for r in got.orderBy("file", "block", "line").collect()]
    assert found == want
    assert Q.unpaired(spark, str(tmp_path / "in")).count() == 0


def test_marks_blank_lines_and_open_quotes(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('﻿k1,"x\r\ny",z\r\n\r\n  \r\nk2,,\r\n'.encode())
    rows = Q.read_quoted(spark, str(tmp_path / "a.csv"), SCHEMA).orderBy("block", "line").collect()
    assert [(r["a"], r["b"], r["c"]) for r in rows] == [("k1", "x\r\ny", "z"), ("k2", None, None)]
    (tmp_path / "bad.csv").write_text('k1,"never closed\nk2,b,c\n')
    assert Q.unpaired(spark, str(tmp_path / "bad.csv")).count() == 1
    with pytest.raises(ValueError, match="quotes"):
        R.item_texts(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "empty.csv").write_text("")
    assert Q.read_quoted(spark, str(tmp_path / "empty.csv"), SCHEMA).count() == 0


def test_item_texts_equal_the_reader_of_whole_files(spark, tmp_path, small_splits):
    rng = random.Random(9)
    as_file(tmp_path / "t.csv", [["item_id", "zh", "en"], *made(rng, 80)])
    whole = spark.read.csv(str(tmp_path / "t.csv"), schema="item string, zh string, en string", quote='"', escape='"', multiLine=True, header=True)
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("item", "zh", "en")]
    got = R.item_texts(spark, str(tmp_path / "t.csv")).select(*blank)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(*blank).collect()))
