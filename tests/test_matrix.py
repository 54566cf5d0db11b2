import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import matrix as M


def values(df):
    return {r["id"]: r["vec"] for r in df.collect()}


def test_a_file_is_read_in_ranges(spark, tmp_path):
    m = np.arange(70, dtype="<f4").reshape(10, 7)
    (tmp_path / "m.bin").write_bytes(m.tobytes())
    df = M.read_matrix(spark, str(tmp_path / "m.bin"), 7, first_id=5, task_rows=3)
    assert df.rdd.getNumPartitions() == 4
    assert values(df) == {k + 5: m[k].tolist() for k in range(10)}
    # each range is one scan of the data source and no Python RDD
    assert "BatchScan" in df._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "empty.bin").write_bytes(b"")
    assert M.read_matrix(spark, str(tmp_path / "empty.bin"), 7).count() == 0
    with pytest.raises(ValueError, match="whole number"):
        M.read_matrix(spark, str(tmp_path / "m.bin"), 9)
    with pytest.raises(FileNotFoundError):
        M.read_matrix(spark, str(tmp_path / "none"), 7)


def test_a_round_trip_over_many_tasks(spark, tmp_path):
    df = spark.range(3, 1003).select("id", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: (F.col("id") * 10 + k).cast("float")).alias("vec"))
    path = f"file://{tmp_path}/out"
    M.write_matrix(df.orderBy(F.rand(1)).repartition(5), path, 5, files=6)
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) > 1 and all(f.name.startswith("part-") for f in files)
    want = np.arange(3, 1003)[:, None] * 10 + np.arange(5)
    assert np.array_equal(np.frombuffer(b"".join(f.read_bytes() for f in files), "<f4").reshape(-1, 5), want.astype("f4"))
    assert values(M.read_matrix(spark, path, 5, 3, 90)) == {r["id"]: r["vec"] for r in df.collect()}
    with pytest.raises(Exception, match="already"):
        M.write_matrix(df, path, 5)
    assert sorted((tmp_path / "out").iterdir()) == files


@pytest.mark.parametrize(
    "rows, says",
    [
        ([(1, [1.0, 2.0]), (2, [1.0])], "numbers"),
        ([(1, [1.0, 2.0]), (3, [1.0, 2.0])], "one by one|one run"),
        ([(1, [1.0, 2.0]), (1, [1.0, 2.0])], "one by one|one run"),
        ([(1, [1.0, None])], "numbers"),
        ([(1, None)], "null"),
        ([(None, [1.0, 2.0])], "null"),
    ],
)
def test_a_wrong_table_leaves_no_file(spark, tmp_path, rows, says):
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    with pytest.raises(Exception, match=says):
        M.write_matrix(df, str(tmp_path / "out"), 2, files=2)
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_an_empty_table_writes_no_rows(spark, tmp_path):
    M.write_matrix(spark.createDataFrame([], "id long, vec array<float>"), str(tmp_path / "out"), 2)
    (tmp_path / "out").mkdir(exist_ok=True)
    assert M.read_matrix(spark, str(tmp_path / "out"), 2).count() == 0
