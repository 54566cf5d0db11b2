"""Artefacts on disk: matrices, codes, vocabularies, results and their manifests.

Tables are Parquet. Spark's commit protocol makes a write all or nothing; ``overwrite=False`` refuses to
replace what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.matrix import read_matrix, write_matrix  # noqa: F401  the matrix readers live there


def save(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_json(df: DataFrame, path: str, order: list[str] | None = None, append: bool = False) -> None:
    """JSON lines; with an order they are sorted by range over the files of the folder."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("append" if append else "errorifexists").json(path)


def codes_table(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(item, codes) cut to the configured length."""
    return spark.read.parquet(path).select("item", F.slice("codes", 1, length).alias("codes"))


def vocabulary(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if size is None:
        return table
    n = table.agg(F.max("token").alias("last"), F.max(F.when(F.col("slot") >= 0, F.col("token"))).alias("atoms")).first()
    if not n["atoms"] < size <= n["last"] + 1:
        raise ValueError("the size must lie between the atoms and the whole vocabulary")
    return table.where(F.col("token") < size)


def manifest(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: the row count and a digest of the content that does not depend on partitions or order.

    Rows are digested one by one and the digests summed in four exact parts, so nothing is gathered."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in [key, *values]])
    d = df.select(F.sha2(text, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 14 * k, 14), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    return d.agg(F.count(F.lit(1)).alias("n_rows"), *parts).select("n_rows", F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"p{k}").cast("string"), F.lit("0")) for k in range(4)]), 256).alias("content_sha256"))


def path_cache(paths: DataFrame, folder: str, identity: str) -> None:
    """Merge paths under the identity of the vocabulary they belong to."""
    save(paths.withColumn("identity", F.lit(identity)), f"{folder}/identity={identity}", overwrite=True)


def cached_paths(spark: SparkSession, folder: str, identity: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/identity={identity}")
