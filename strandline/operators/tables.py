"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that lazy results may still read; they go when it ends.
_LEFT: dict[str, SparkSession] = {}
_OWNER = os.getpid()


def scratch_root(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, a session on this machine alone makes one, and on
    a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _at_exit() -> None:
    if os.getpid() == _OWNER:
        for path, spark in list(_LEFT.items()):
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone: nothing is left to do then
                return


atexit.register(_at_exit)


def kept(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a written table: its lineage is cut, and every later pass reads the same rows. by: a column whose values get a
    folder each, so that a filter on it reads those alone; it comes last in the table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    schema = df.schema if by is None else df.select(*[c for c in df.columns if c != by], by).schema
    out = spark.read.schema(schema).parquet(path)
    out._strandline_path = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing lazy reads any more; other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_strandline_path", None)
        if path in _LEFT:
            _delete(_LEFT.pop(path), path)


def named(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is the same for the same name; it goes when the process ends."""
    path = f"{scratch_root(spark)}/{name}"
    _LEFT[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
