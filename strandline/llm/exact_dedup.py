"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of a text, with one partition for
every batch that was added under a name. New rows are reduced to one row per digest first (with partial aggregation,
so a huge group of copies costs one row per task), then a sort-merge anti-join against the bucketed index, which is
read without a shuffle, finds the digests that no other batch has, and the batch is appended. Everything runs in the JVM.

A batch may run again, after a driver was lost at any point: what it left before goes first, and so its own earlier
rows never count against it. There are at least as many buckets as shuffle partitions (else Spark would
shuffle the index), and one for every ROWS_PER_BUCKET digests of the first batch; every batch adds one file to a
bucket. ``compact`` writes all batches as one, with buckets for the size of that.

Defined results for odd input: a null text counts as the empty text; a null doc_id loses to any
other; of rows that repeat both doc_id and text exactly one is kept; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep_rows, read, scratch_path, stored, text_or_empty

ROWS_PER_BUCKET = 4_000_000
COLUMNS = "digest BINARY, owner_id BIGINT, owner_row BIGINT, n BIGINT, batch STRING"


def digest_rows(docs: DataFrame, batch: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, row_id and batch of every row, as a stored table."""
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    return stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("row_id"), batch.alias("batch")), "digests")


class DigestIndex:
    """A digest index at a path that outlives the session.

    Opening the same path again continues the index: rows whose digest another batch has are duplicates of the
    document recorded there, whatever their own doc_id is. A version of the index is a folder named by its number
    and its buckets, valid once it has a ``_DONE`` folder; the largest valid one counts.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark = spark
        self.path = path or scratch_path(spark, "digest-index")
        self.rows_per_bucket = rows_per_bucket
        self.table = None
        jvm = spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        found = sorted((int(x.split("-")[0][1:]), int(x.split("-")[1]), x) for x in names if self._fs.exists(self._at(f"{x}/_DONE")))
        self.version, self.buckets = -1, 0
        if found:
            self.version, self.buckets, name = found[-1]
            self._open(name)
            self.spark.sql(f"MSCK REPAIR TABLE {self.table}")

    def _open(self, name: str) -> None:
        table = f"digest_index_{uuid.uuid4().hex[:12]}"
        self.spark.sql(
            f"CREATE TABLE {table} ({COLUMNS}) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        self.close()
        self.table = table

    def _begin(self, rows: int) -> str:
        """A folder for a new version with buckets for so many digests; what an attempt left there goes."""
        self.version += 1
        self.buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // self.rows_per_bucket))
        name = f"v{self.version}-{self.buckets}"
        self._fs.delete(self._at(name), True)
        self._open(name)
        return name

    def rows(self) -> DataFrame:
        """digest, owner_id, owner_row, n, batch: of every batch the digests it brought, only those that no other batch had."""
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the table's name; the files stay (the table is external)."""
        if self.table:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None

    def append(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch, or add it again; its rows as digest_rows gives them."""
        digests = digest_rows(docs, F.lit(batch), id_col, text_col)
        self.record(digests, batch)
        return digests

    def record(self, digests: DataFrame, batch: str) -> None:
        """Add rows of digest_rows to the index as a batch."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError("a batch is named by letters, digits, points, lines and dashes")
        # nulls order below every id in a struct maximum
        groups = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row_id")).alias("top"), F.count(F.lit(1)).alias("n"))
        groups = groups.select("digest", F.col("top.doc_id").alias("owner_id"), F.col("top.row_id").alias("owner_row"), "n")
        if self.table is None:
            name = self._begin(digests.count())
            self._fs.mkdirs(self._at(f"{name}/_DONE"))
        # what an earlier attempt at this batch has left goes first
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (batch = '{batch}')")
        self._fs.delete(self._at(f"v{self.version}-{self.buckets}/batch={batch}"), True)
        others = self.rows().where(F.col("batch") != batch).select("digest")
        new = groups.join(others, "digest", "left_anti").withColumn("batch", F.lit(batch))
        new.write.insertInto(self.table)

    def rule(self, digests: DataFrame, batches: list[str]) -> DataFrame:
        """Verdicts on rows that were appended (the result of append, or a union of such, with the names of their batches):
        doc_id, keep_id, group_size, kept, text_sha256. group_size counts these rows, and those of another batch
        that were recorded when it appended the digest."""
        sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("own_n"))
        owned = self.rows().select("digest", "owner_id", "owner_row", F.col("batch").alias("owner_batch"), "n")
        other = F.when(F.col("owner_batch").isin(batches), F.lit(0)).otherwise(F.col("n"))
        # written, so that both sides of the row-level join are dealt by their own exchange and
        # adaptive execution can split the partition of a digest that many rows share
        resolved = stored(sizes.join(owned, "digest").select("digest", "owner_id", "owner_row", "owner_batch", (F.col("own_n") + other).alias("group_size")), "resolved")
        return digests.join(resolved, "digest").select(
            "doc_id",
            F.col("owner_id").alias("keep_id"),
            "group_size",
            ((F.col("batch") == F.col("owner_batch")) & (F.col("row_id") == F.col("owner_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def add(self, docs: DataFrame, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate docs within themselves and against the other batches, and append them: one row per input row.
        A batch that may run again needs a name of its own, always the same one."""
        name = batch or uuid.uuid4().hex
        return self.rule(self.append(docs, name, id_col, text_col), [name])

    def compact(self) -> None:
        """Write all batches as one, one sorted file a bucket, with buckets for the size they have come to. The old
        version goes when the new one is complete, so a compaction that is lost on the way changes nothing. Owners then belong
        to the batch ``compacted``: a batch that ran before cannot be run again after it."""
        if self.table is None:
            return
        old, before = self.table, f"v{self.version}-{self.buckets}"
        rows = self.rows().select("digest", "owner_id", "owner_row", "n", F.lit("compacted").alias("batch"))
        total = rows.count()
        self.table = None
        name = self._begin(total)
        # dealt as the buckets are, so a task writes one file
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)
        self._fs.mkdirs(self._at(f"{name}/_DONE"))
        self.spark.sql(f"DROP TABLE IF EXISTS {old}")
        self._fs.delete(self._at(before), True)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """Verdicts for every row of docs; without an index, a new one is used for this call."""
    own = index or DigestIndex(docs.sparkSession)
    out = own.add(docs, batch)
    if index is None:
        own.close()
        discard(docs.sparkSession, own.path)
    return out


def exact_dedup_in_batches(docs: DataFrame, batches: int = 2, index: DigestIndex | None = None) -> DataFrame:
    """Verdicts for every row of docs, added to the index in batches of descending doc_id, so that the batch which has a
    text first also has its largest doc_id. Rows without a doc_id are in the last batch."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark)
    key = F.col("doc_id").cast("long")
    low, high = docs.agg(F.min(key), F.max(key)).first()
    low, high = (0, 0) if low is None else (low, high)
    bounds = [low + (high - low + 1) * k // batches for k in range(batches - 1, 0, -1)]
    names = [f"part-{k:04d}" for k in range(batches)]
    batch = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds, strict=True))):
        batch = F.when(key >= bound, F.lit(name)).otherwise(batch)
    digests = digest_rows(docs, batch)
    for name in names:
        own.record(digests.where(F.col("batch") == name), name)
    out = own.rule(digests, names)
    if index is None:
        own.close()
        discard(spark, own.path)
    return out


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns. Rows that repeat doc_id and text count once."""
    ruled = exact_dedup(docs).where("kept").select("doc_id", F.unhex("text_sha256").alias("digest"))
    return keep_rows(docs, ruled)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_in_batches(read(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
