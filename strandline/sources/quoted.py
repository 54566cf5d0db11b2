"""Comma files whose quoted fields may hold line breaks, read by many tasks.

Files are split at line feeds as any text is. Whether a line begins inside quotes is the parity of the quotes before it in
its file: those of earlier blocks, from one small row a block, and those of earlier lines of its own block. A line outside
quotes begins a record, and a record is its lines joined again. So no file is one task, as it is for a reader that has to
go through all of it to know where its records begin. Files are scanned twice, and must not change between.

A quote is only special where it wraps a field, and is doubled inside one; a file whose quotes do not pair up is named by
``unpaired``. A carriage return before a line feed goes where a record ends and stays inside a field. Blank records
are skipped, and a byte order mark at the start of a file is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line, value, quotes): block is where the split begins in its file, line grows inside a block."""
    raw = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    value = F.when(meta["file_block_start"] == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    rows = raw.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), value.alias("value"))
    return rows.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))


def _blocks(lines: DataFrame) -> DataFrame:
    """(file, block, before, open_record): quotes in earlier blocks of the file, and the block and line at which the record
    that is open where the block begins has begun."""
    own = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(own), F.lit(0))
    at = F.struct("block", "line")
    # a block does not know yet whether it begins inside quotes, so it says where its last record begins in either case
    per = lines.withColumn("odd", inside % 2).groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"), F.max(F.when(F.col("odd") == 0, at)).alias("even_start"), F.max(F.when(F.col("odd") == 1, at)).alias("odd_start")
    )
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("quotes").over(by_file), F.lit(0)))
    start = F.when(F.col("before") % 2 == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    return per.withColumn("start", start).select("file", "block", "before", F.max("start").over(by_file).alias("open_record"))


def records(spark: SparkSession, path) -> DataFrame:
    """(file, block, line, record): the whole text of every record, and where it begins."""
    lines = _lines(spark, path)
    known = lines.join(_blocks(lines), ["file", "block"])
    own = Window.partitionBy("file", "block").orderBy("line")
    inside = F.col("before") + F.coalesce(F.sum("quotes").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumn("begins", inside % 2 == 0)
    last = F.max(F.when(F.col("begins"), F.struct("block", "line"))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    known = known.withColumn("start", F.coalesce(last, "open_record"))
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "value")))
    whole = known.groupBy("file", "start").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    out = whole.select("file", F.col("start.block").alias("block"), F.col("start.line").alias("line"), F.regexp_replace("record", "\r$", "").alias("record"))
    return out.where(F.trim("record") != "")


def unpaired(spark: SparkSession, path) -> DataFrame:
    """(file) of files whose quotes do not pair up: their last record would run to the end of the file."""
    return _lines(spark, path).groupBy("file").agg(F.sum("quotes").alias("n")).where(F.col("n") % 2 == 1).select("file")


def read_quoted(spark: SparkSession, path, schema: str) -> DataFrame:
    """(file, block, line, fields of schema) of every record."""
    cut = F.from_csv("record", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    return records(spark, path).withColumn("_r", cut).select("file", "block", "line", "_r.*")
