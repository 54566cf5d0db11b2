"""Text record sources: lenient JSON lines, behaviour files, pair files, catalogues, manifests and logs.

Checks are queries: each reader returns its rows, and ``violations`` functions return the rows that break a
rule, so a bad file costs a scan and no driver loop. ``require_empty`` turns one into an error."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources import quoted

_WORD = {"true": "True", "false": "False", "null": "None"}


def _literal(line: str) -> str | None:
    """A line that is no JSON, read as a Python literal after true, false and null are renamed; as JSON."""
    try:
        value = ast.literal_eval(re.sub("true|false|null", lambda m: _WORD[m.group()], line))
        return json.dumps(value) if isinstance(value, dict) else None
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None


@F.pandas_udf(T.StringType())
def _repair(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: _literal(x) if isinstance(x, str) else None)


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line, value): line numbers follow the order within a file.

    A compressed file is one task; a plain one is split, and its numbers then come from byte order, which
    monotonically increasing ids keep within a file."""
    df = spark.read.text(path)
    return df.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), "value")


def utf8_violations(lines: DataFrame) -> DataFrame:
    """(file, line) of lines that are no UTF-8."""
    return lines.where(~F.is_valid_utf8("value")).select("file", "line")


def lenient_json(spark: SparkSession, path, schema: str | T.StructType, spread: int | None = None, strict_utf8: bool = False) -> DataFrame:
    """(file, line, fields of schema) of JSON lines, gzip included; lines that neither JSON nor a literal
    reading understands are skipped.

    Only lines that fail strict JSON visit Python. ``spread`` deals the rows of an unsplittable file out.
    Bytes that are no UTF-8 are replaced, or with ``strict_utf8`` an error."""
    lines = numbered_lines(spark, path)
    if strict_utf8:
        lines = lines.withColumn("value", F.validate_utf8("value"))
    lines = lines.where(F.trim("value") != "")
    if spread:
        lines = lines.repartition(spread)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    full = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    probe = T.StructType([*full.fields, T.StructField("_bad", T.StringType())])
    strict = lines.withColumn("_r", F.from_json("value", probe, options))
    good = strict.where("_r is not null and _r._bad is null")
    again = strict.where("_r is null or _r._bad is not null").withColumn("_fixed", _repair("value")).where("_fixed is not null")
    again = again.withColumn("_r", F.from_json("_fixed", probe, options)).where("_r is not null and _r._bad is null")
    names = [f"_r.{f.name}" for f in full.fields]
    return good.select("file", "line", *names).unionByName(again.select("file", "line", *names))


def reviews(spark: SparkSession, path) -> DataFrame:
    """(user, item, ts, ord) of review records; ord keeps the file order for stable sorting."""
    raw = lenient_json(spark, path, "reviewerID string, asin string, unixReviewTime bigint")
    return raw.select(F.col("reviewerID").alias("user"), F.col("asin").alias("item"), F.col("unixReviewTime").alias("ts"), F.col("line").alias("ord"))


def review_profile(log: DataFrame) -> DataFrame:
    return log.agg(F.count_distinct("item").alias("n_items"), F.count_distinct("user").alias("n_users"), F.count(F.lit(1)).alias("n_rows"))


METADATA = (
    "asin string, title string, price string, brand string, feature array<string>, categories array<array<string>>, "
    "description string, imUrl string, imageURLHighRes array<string>, imageURL array<string>"
)


def metadata(spark: SparkSession, path) -> DataFrame:
    return lenient_json(spark, path, METADATA).withColumnRenamed("asin", "item")


def behaviours(spark: SparkSession, path) -> DataFrame:
    """(user, seq, line, n_fields) of a two-column file: a user and items parted by blanks."""
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    parts = F.split("value", "\t")
    seq = F.filter(F.split(F.trim(F.coalesce(F.get(parts, 1), F.lit(""))), r"\s+"), lambda x: x != "")
    return lines.where(F.trim("value") != "").select(F.trim(F.get(parts, 0)).alias("user"), seq.alias("seq"), "line", F.size(parts).alias("n_fields"))


def behaviour_violations(rows: DataFrame) -> DataFrame:
    """(rule, user): wrong field counts, empty users or sequences, users that repeat."""
    shape = rows.select(
        F.when(F.col("n_fields") != 2, "fields").when(F.col("user") == "", "empty user").when(F.size("seq") == 0, "empty sequence").alias("rule"), "user"
    ).where("rule is not null")
    twice = rows.groupBy("user").count().where("count > 1").select(F.lit("repeated user").alias("rule"), "user")
    return shape.unionByName(twice)


def behaviour_log(rows: DataFrame) -> DataFrame:
    """(user, item, ts, ord): sequences as interactions; positions stand for time."""
    return rows.select("user", F.posexplode("seq").alias("ts", "item"), (F.col("line") * 1).alias("ord")).select("user", "item", F.col("ts").cast("double").alias("ts"), "ord")


def _pair_fields(spark: SparkSession, path, columns: tuple[str, str]) -> DataFrame:
    raw = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    # quoted fields are read as in any comma file; a field does not go on in the next line
    cut = F.from_csv("value", "a string, b string, c string", {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    out = raw.withColumn("_r", cut).withColumn("_raw", F.trim("_r.c"))
    names = {columns[0]: F.trim("_r.a"), columns[1]: F.trim("_r.b")}
    out = out.select("file", "line", names["user"].alias("user"), names["item"].alias("item"), "_raw", F.expr("try_cast(_raw as double)").alias("ts"))
    # a line that names the columns is none of the pairs
    return out.where(~F.coalesce(F.lower("_raw").isin("timestamp", "time", "ts"), F.lit(False)))


def pair_violations(spark: SparkSession, path, columns: tuple[str, str] = ("item", "user")) -> DataFrame:
    """(rule, file, line): fewer than three fields, an empty user or item, a time that is no finite number."""
    rows = _pair_fields(spark, path, columns)
    rule = F.when(F.col("_raw").isNull(), "fields").when((F.coalesce("user", F.lit("")) == "") | (F.coalesce("item", F.lit("")) == ""), "empty")
    finite = F.col("ts").isNotNull() & ~F.isnan("ts") & (F.abs("ts") < float("inf"))
    return rows.select(rule.when(~F.coalesce(finite, F.lit(False)), "time").alias("rule"), "file", "line").where("rule is not null")


def pairs(spark: SparkSession, path, columns: tuple[str, str] = ("item", "user"), check: bool = True) -> DataFrame:
    """(user, item, ts, line) of a comma file in either column order, with quotes and a byte order mark, blank lines
    and a header skipped. A row that breaks a rule of pair_violations is an error, found in a scan before; without
    the check such rows are left out."""
    if check:
        require_empty(pair_violations(spark, path, columns), f"pairs in {path}")
    rows = _pair_fields(spark, path, columns).where("user <> '' and item <> '' and ts is not null and not isnan(ts) and abs(ts) < double('infinity')")
    return rows.select("user", "item", "ts", "line")


def item_texts(spark: SparkSession, path) -> DataFrame:
    """(item, zh, en) of a quoted comma file; a first line that names the columns is dropped. Quotes that do not pair up
    are an error, found in a scan before; fields may hold line breaks, and a file is still read by many tasks."""
    require_empty(quoted.unpaired(spark, path), "quotes that do not pair up")
    raw = quoted.read_quoted(spark, path, "item string, zh string, en string").select("item", "zh", "en")
    return raw.where(~F.lower("item").isin("item_id", "item", "itemid"))


def item_text_violations(rows: DataFrame) -> DataFrame:
    empty = rows.where("item is null or trim(item) = '' or (coalesce(trim(zh), '') = '' and coalesce(trim(en), '') = '')").select(F.lit("empty").alias("rule"), "item")
    return empty.unionByName(rows.groupBy("item").count().where("count > 1").select(F.lit("repeated item").alias("rule"), "item"))


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples if a check found anything."""
    some = violations.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {[tuple(r) for r in some]}")


def image_manifest(spark: SparkSession, path) -> DataFrame:
    """(item, status, path) of a manifest, under its present or its older key name."""
    raw = spark.read.schema("item_id string, asin string, status string, path string").json(path)
    return raw.select(F.coalesce("item_id", "asin").alias("item"), "status", "path")


def manifest_violations(rows: DataFrame) -> DataFrame:
    missing = rows.where("item is null").select(F.lit("no item").alias("rule"), "item")
    return missing.unionByName(rows.groupBy("item").count().where("count > 1").select(F.lit("repeated item").alias("rule"), "item"))


def status_manifest(spark: SparkSession, path) -> DataFrame:
    """The last status of each item; lines that cannot be read are skipped."""
    raw = lenient_json(spark, path, "item_id string, asin string, status string, path string")
    keyed = raw.select(F.coalesce("item_id", "asin").alias("item"), F.struct("status", "path").alias("v"), F.struct("file", "line").alias("at")).where("item is not null")
    return keyed.groupBy("item").agg(F.max_by("v", "at").alias("v")).select("item", "v.status", "v.path")


def images(spark: SparkSession, path: str, suffixes=(".jpg", ".jpeg", ".png", ".webp")) -> DataFrame:
    """(item, path, length) of an image folder by file stem; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    end = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.where(end.isin(list(suffixes))).select(F.regexp_replace(name, r"\.[^.]+$", "").alias("item"), "path", "length")


def image_violations(files: DataFrame) -> DataFrame:
    """(rule, item): items with several pictures."""
    return files.groupBy("item").count().where("count > 1").select(F.lit("repeated item").alias("rule"), "item")


def image_base64(spark: SparkSession, path: str) -> DataFrame:
    """(item, data): contents as data addresses."""
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    data = F.concat(F.lit("data:image/"), F.when(kind == "jpg", "jpeg").otherwise(kind), F.lit(";base64,"), F.base64("content"))
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("item"), data.alias("data"))


def available(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest rows that are downloaded and whose file exists."""
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("_name"))
    named = manifest.where("status = 'downloaded'").withColumn("_name", F.element_at(F.split("path", "/"), -1))
    return named.join(there.distinct(), "_name", "left_semi").drop("_name")


def with_image_status(items: DataFrame, files: DataFrame) -> DataFrame:
    """items with path and status (downloaded or missing)."""
    out = items.join(files.select("item", "path"), "item", "left")
    return out.withColumn("status", F.when(F.col("path").isNull(), "missing").otherwise("downloaded"))


def merge_log(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The records of a merge log, and the number of lines that cannot be read (one row)."""
    from strandline.operators.merge_log import SCHEMA

    raw = spark.read.text(path).where(F.trim("value") != "")
    schema = T.StructType([*T._parse_datatype_string(SCHEMA).fields, T.StructField("_bad", T.StringType())])
    rows = raw.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    return rows.where("_bad is null").drop("_bad"), rows.agg(F.count("_bad").alias("n_malformed"))


def batch_results(spark: SparkSession, path, expected: DataFrame) -> DataFrame:
    """(item, problem): results of a batch job against the expected items: missing, unexpected, repeated, failed."""
    got = spark.read.schema("item_id string, error string, embedding array<float>").json(path)
    seen = got.groupBy(F.col("item_id").alias("item")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("error").isNotNull() | F.col("embedding").isNull()).alias("bad"))
    both = expected.select("item").withColumn("_e", F.lit(True)).join(seen, "item", "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(F.col("bad"), "failed")
    return both.select("item", problem.alias("problem")).where("problem is not null")


def catalogue(spark: SparkSession, path, schema: str = "item_id string, title string, text string, image_url string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def discover(spark: SparkSession, folder: str, names: list[str]) -> str:
    """The first of the candidate names in a folder or one folder below, listed through Spark's file systems."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    places = [path] + [s.getPath() for s in fs.listStatus(path) if s.isDirectory()]
    for place in places:
        for name in names:
            one = jvm.org.apache.hadoop.fs.Path(place, name)
            if fs.exists(one):
                return one.toString()
    raise FileNotFoundError(f"none of {names} in {folder}")
