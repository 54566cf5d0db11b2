"""The driver's tables in the engine's data model, as DataFrames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What orders the purchases of a customer: time, then the whole key.
ORDER = ("ts", "okey", "line", "item", "supp")


def purchase_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their lines, as far as purchases are made of them."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line")
    )
    return o, li


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, ts, okey, line, supp): customers buy parts."""
    o, li = purchase_tables(spark, sf_dir)
    return li.join(o, "o_orderkey").withColumnRenamed("o_orderkey", "okey")


PURCHASES = """
SELECT o_custkey AS user, l_partkey AS item, o_orderdate AS ts, l_orderkey AS okey, l_linenumber AS line, l_suppkey AS supp
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
BY_TIME = "ts, okey, line, item, supp"

SEQS = f"SELECT user, list(item ORDER BY {BY_TIME}) AS seq FROM ({PURCHASES}) GROUP BY user"


def item_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, feats): brand, type and size of a part as three code slots."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    kind = F.pmod(F.crc32("p_type"), F.lit(97)).cast("int")
    return p.select(F.col("p_partkey").alias("item"), F.array(brand, kind, F.col("p_size").cast("int")).alias("feats"))


def four_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, codes, n): four slots from the key and size of a part, and how often it was bought."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    codes = F.array((k % 7).cast("int"), (k % 11).cast("int"), F.col("p_size").cast("int"), (k % 5).cast("int"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return p.select(k.alias("item"), codes.alias("codes")).join(n, "item")


FOUR = """
SELECT p_partkey AS item, [p_partkey % 7, p_partkey % 11, p_size, p_partkey % 5] AS codes, n
FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey
"""


def slot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, feats) of three small slots, with collisions."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("item"), F.array((k % 7).cast("int"), (k % 11).cast("int"), F.col("p_size").cast("int")).alias("feats"))


SLOT_ITEMS = "SELECT p_partkey AS item, [p_partkey % 7, p_partkey % 11, p_size] AS feats FROM part"
ATOMS = f"""
SELECT row_number() OVER (ORDER BY slot, code) AS token, slot, code FROM (
  SELECT DISTINCT unnest([0, 1, 2]) AS slot, unnest(feats) AS code FROM ({SLOT_ITEMS}))
"""
STATES = f"""
SELECT user, pos, list(token ORDER BY slot) AS state FROM (
  SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY {BY_TIME}) - 1 AS pos FROM ({PURCHASES})) p
JOIN (SELECT item, slot, token FROM (SELECT item, unnest([0, 1, 2]) AS slot, unnest(feats) AS code FROM ({SLOT_ITEMS})) f JOIN ({ATOMS}) a USING (slot, code)) t USING (item)
GROUP BY user, pos
"""


def log_of_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge log derived from the orders: a step per order, operands that are atoms or earlier tokens."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    step = (F.col("o_orderkey") + 1).cast("int")
    c, k = F.col("o_custkey").cast("int"), F.col("o_orderkey").cast("int")
    earlier = lambda x: F.when((x % 3 == 0) & (step > 1), 1000 + 1 + x % (step - 1))
    left, right = earlier(c), earlier(k + c)
    atom = lambda x: F.array(x % 9, x % 256)
    slots = F.array_sort(F.array_distinct(F.array(c % 9, k % 9, (c + k) % 4)))
    return o.select(
        F.lit("merge").alias("event"), step.alias("step"), (1000 + step).alias("new_token"),
        F.coalesce(left, c % 9).alias("left"), F.coalesce(right, (k + c) % 9).alias("right"),
        F.when(left.isNull(), atom(c)).otherwise(F.array(F.lit(-1), c, k)).alias("left_rule"),
        F.when(right.isNull(), atom(k + c)).otherwise(F.array(F.lit(-1), c, k)).alias("right_rule"),
        slots.alias("slots"), F.col("o_totalprice").alias("priority"), (c % 100).cast("double").alias("affected_sequences"),
    )


_LOG = """
SELECT o_orderkey + 1 AS step, 1001 + o_orderkey AS new_token, o_totalprice AS priority, o_custkey % 100 AS affected,
  CASE WHEN o_custkey % 3 = 0 AND o_orderkey > 0 THEN 1001 + o_custkey % o_orderkey END AS l,
  CASE WHEN (o_orderkey + o_custkey) % 3 = 0 AND o_orderkey > 0 THEN 1001 + (o_orderkey + o_custkey) % o_orderkey END AS r,
  o_custkey % 9 AS ls, (o_orderkey + o_custkey) % 9 AS rs,
  list_sort(list_distinct([o_custkey % 9, o_orderkey % 9, (o_custkey + o_orderkey) % 4])) AS slots
FROM orders
"""
_KIND = """CASE WHEN {0} IS NULL THEN NULL
  WHEN len(list_filter({0}, lambda x: x < 4)) > 0 AND len(list_filter({0}, lambda x: x >= 4 AND x < 8)) > 0 THEN 'mixed'
  WHEN len(list_filter({0}, lambda x: x < 4)) > 0 THEN 'text' WHEN len(list_filter({0}, lambda x: x >= 4 AND x < 8)) > 0 THEN 'image' ELSE 'hash' END"""
CLASSIFIED = f"""
SELECT step, new_token, priority, affected, list_contains(slots, 8) AS includes_hash,
  CASE ko WHEN 'mixed' THEN 'text_image' WHEN 'text' THEN 'text_only' WHEN 'image' THEN 'image_only' ELSE 'hash_only' END AS output,
  CASE WHEN kl IS NULL OR kr IS NULL THEN 'unknown'
    WHEN list_contains(lsl, 8) OR list_contains(rsl, 8) THEN 'hash_related'
    WHEN kl = kr THEN kl || '_' || kr
    WHEN least(kl, kr) = 'image' AND greatest(kl, kr) = 'text' THEN 'text_image'
    WHEN kl = 'mixed' THEN 'mixed_' || kr ELSE 'mixed_' || kl END AS transition
FROM (SELECT *, {_KIND.format("slots")} AS ko, {_KIND.format("lsl")} AS kl, {_KIND.format("rsl")} AS kr FROM (
  SELECT a.*, CASE WHEN a.l IS NULL THEN [a.ls] ELSE x.slots END AS lsl, CASE WHEN a.r IS NULL THEN [a.rs] ELSE y.slots END AS rsl
  FROM ({_LOG}) a LEFT JOIN ({_LOG}) x ON x.new_token = a.l AND x.step < a.step LEFT JOIN ({_LOG}) y ON y.new_token = a.r AND y.step < a.step))
"""


def predictions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rankings (example, member, rank, codes) and labels (example, label, source) derived from order lines."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_extendedprice")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    codes = F.array((F.col("l_partkey") % 6).cast("int"), (F.col("l_suppkey") % 4).cast("int"))
    preds = li.select(F.col("l_orderkey").alias("example"), F.col("l_returnflag").alias("member"), rank.alias("rank"), F.when(F.col("l_quantity") < 8, F.array(F.lit(-1), F.lit(-1))).otherwise(codes).alias("codes"))
    o = table(spark, sf_dir, "orders")
    label = F.array((F.col("o_custkey") % 6).cast("int"), (F.col("o_custkey") % 4).cast("int"), F.lit(99), F.lit(0))
    return preds, o.select(F.col("o_orderkey").alias("example"), label.alias("label"), F.col("o_orderpriority").alias("source"))


PREDS = """
SELECT l_orderkey AS example, l_returnflag AS member,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank,
  CASE WHEN l_quantity < 8 THEN [-1, -1] ELSE [l_partkey % 6, l_suppkey % 4] END AS codes
FROM lineitem
"""
LABELS = "SELECT o_orderkey AS example, [o_custkey % 6, o_custkey % 4] AS label, o_orderpriority AS source FROM orders"
HITS = f"SELECT l.example, l.source, min(p.rank) AS hit FROM ({LABELS}) l LEFT JOIN ({PREDS}) p ON p.example = l.example AND p.codes = l.label GROUP BY ALL"
