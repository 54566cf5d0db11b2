"""Collision digits of tuples that more items have than there are buckets."""

import pytest
from pyspark.errors import PySparkException

from strandline.operators import item_codes as K
from strandline.plans import extraction


def items(spark, n):
    return spark.createDataFrame([(k, [k % 2, 5]) for k in range(n)], "item long, codes array<int>")


def test_more_items_than_buckets(spark):
    with pytest.raises(PySparkException, match="more items of one code tuple"):
        K.with_collision_digit(items(spark, 10), buckets=4).collect()
    once = {r["item"]: r["feats"] for r in K.with_collision_digit(items(spark, 8), buckets=4).collect()}
    again = {r["item"]: r["feats"] for r in K.with_collision_digit(items(spark, 48), buckets=4, more="repeat").collect()}
    more = {r["item"]: r["feats"] for r in K.with_collision_digit(items(spark, 48), buckets=4, more="digits").collect()}
    for k in range(48):
        assert again[k] == once[k % 8]  # the permutation starts again
        rounds = k // 8
        assert more[k] == again[k][:2] + ([rounds // 4] if rounds > 3 else []) + ([rounds % 4] if rounds else []) + again[k][2:]
    assert len(set(map(tuple, more.values()))) == 48


def parts(spark, tmp_path):
    """600 parts of two tuples, 300 each."""
    rows = [(77 * k, k % 2) for k in range(600)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_collision_digits_beyond_256_items(spark, tmp_path):
    got = {r["item"]: r["feats"].split() for r in extraction.collision_digits(spark, parts(spark, tmp_path)).collect()}
    assert len(got) == 600 and all(len(f) == 4 and int(f[3]) < 256 for f in got.values())
    assert len({tuple(f) for f in got.values()}) == 512 and got[0] == got[77 * 512]


def test_unique_features_beyond_256_items(spark, tmp_path):
    assert tuple(extraction.unique_features(spark, parts(spark, tmp_path)).first()) == (600, 600, True)
