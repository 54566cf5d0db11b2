"""Helpers shared by the training-data operators.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``,
because driver and executors share no other folder on a cluster.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage, as in a Java regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a session on this machine alone makes one; on a
    cluster that would be a folder the executors do not share, so it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Scratch paths of this process that lazy results may still read; they go when it ends.
_LEFT: dict[str, SparkSession] = {}
_OWNER = os.getpid()


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


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: this cuts the lineage,
    and a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete scratch tables that nothing lazy reads any more."""
    for x in tables:
        path = x if isinstance(x, str) else getattr(x, "_strandline_path", None)
        if path:
            _delete(spark, path)
            _LEFT.pop(path, None)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs found in keep (doc_id, digest: the first bytes of the text's SHA-256), once each.

    Texts are digested where they are read."""
    kept_id, kept_digest, digest, n = (fresh(docs, x) for x in ("_keep_id", "_keep_digest", "_digest", "_n"))
    keep = stored(keep.select(F.col("doc_id").alias(kept_id), F.substring("digest", 1, 16).alias(kept_digest)), "keep")
    marked = docs.withColumn(digest, F.substring(F.unhex(F.sha2(text_or_empty(), 256)), 1, 16))
    same = (F.col(digest) == F.col(kept_digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id))
    # rows equal in doc_id and text are all found; only where there are any is a distinct needed, and there a
    # null text counts as empty, as it does for the digest
    keys = docs.select(F.col("doc_id"), F.xxhash64(text_or_empty()).alias(n)).groupBy("doc_id", n).count()
    out = marked.join(keep, same, "left_semi")
    if keys.where(F.col("count") > 1).limit(1).count():
        out = out.dropDuplicates(["doc_id", digest])
    return out.drop(digest)


def repeatable(df: DataFrame) -> DataFrame:
    """df, if a second pass is sure to see the same rows in the same order, as plain scans of files do; else
    df as a written table. Operators that number rows and read their input twice need this."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stored(df, "input") if any(x in plan for x in ("Exchange", "Join", "Aggregate", "ExistingRDD", "Sample", "InPandas", "InArrow")) else df
