"""User sequences from interactions: order, ids, splits, windows and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(log: DataFrame, user: str = "user", order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """log with pos, the place of a row in its user's time order (1 first). The last order column has
    to be unique within a user (file order), which makes the sort stable."""
    return log.withColumn("pos", F.row_number().over(Window.partitionBy(user).orderBy(*order)))


def sequences(log: DataFrame, user: str = "user", item: str = "item", order: tuple[str, ...] = ("ts", "ord")) -> DataFrame:
    """(user, seq): items in time order. One shuffle on the user; map-side sorting is left to Tungsten."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"))))
    return log.groupBy(user).agg(F.transform(rows, lambda x: x["_item"]).alias("seq"))


def first_appearance_ids(log: DataFrame, value: str, first: list[Column]) -> DataFrame:
    """(value, id): ids from 1 by first appearance; 0 is the pad.

    first: the global order of rows. The distinct values are ordered, not the rows. Ranks come from a
    range-partitioned sort with an offset by partition, so the values are never in one task."""
    keys = log.groupBy(value).agg(F.min(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(first)])).alias("_first"))
    return dense_ids(keys, "_first").select(value, "id")


def dense_ids(rows: DataFrame, order: str, start: int = 1) -> DataFrame:
    """rows with id: 1, 2, ... in the order of a unique column, numbered partition by partition.

    Only one number a partition (its row count) goes through a window without keys. What is numbered is
    cut into the partitions by range first and then kept as a table, so both passes see the same cut."""
    from strandline.operators.tables import kept

    cut = kept(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "dense-ids")
    counts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    # one row for each partition: broadcasting it is safe at any size of the input
    out = cut.withColumn("_local", local).join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn("id", (F.col("_before") + F.col("_local") + (start - 1)).cast("long")).drop("_part", "_local", "_before")


def leave_one_out(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """seqs in long form with split: test (whole), val (without the last) and train (without the last two)."""
    n = F.size(seq)
    splits = F.array(
        F.struct(F.lit("test").alias("split"), F.col(seq).alias("part")),
        F.when(n > 1, F.struct(F.lit("val").alias("split"), F.slice(seq, F.lit(1), n - 1).alias("part"))),
        F.when(n > 2, F.struct(F.lit("train").alias("split"), F.slice(seq, F.lit(1), n - 2).alias("part"))),
    )
    rest = [c for c in seqs.columns if c != seq]
    return seqs.select(*rest, F.inline(F.array_compact(splits))).withColumnRenamed("part", seq)


def split(seqs: DataFrame, strategy: str = "leave_one_out", seq: str = "seq") -> DataFrame:
    if strategy not in ("leave_one_out", "last_out"):
        raise ValueError(f"unknown split strategy {strategy}")
    return leave_one_out(seqs, seq)


def prefix_windows(seqs: DataFrame, most: int = 20, seq: str = "seq") -> DataFrame:
    """Training examples: for every target after the first item, up to ``most`` items of history and it."""
    n = F.size(seq)
    rest = [c for c in seqs.columns if c != seq]
    at = seqs.where(n > 1).select(*rest, seq, F.explode(F.sequence(F.lit(2), n)).alias("target_pos"))
    start = F.greatest(F.col("target_pos") - most, F.lit(1))
    return at.withColumn("window", F.slice(seq, start, F.col("target_pos") - start + 1)).drop(seq)


def last_window(seqs: DataFrame, most: int = 20, seq: str = "seq") -> DataFrame:
    """Evaluation examples: the last ``most`` items of history and the target."""
    n = F.size(seq)
    return seqs.withColumn("window", F.slice(seq, F.greatest(n - most, F.lit(1)), F.lit(most + 1)))


def example_windows(seqs: DataFrame, split: str, most: int = 20, seq: str = "seq") -> DataFrame:
    """History and target as window, for the examples of a split of leave-one-out: of train every prefix of the sequence
    without its last two items, of val and test the last window of the sequence without its last item and of all of it."""
    if split not in ("train", "val", "test"):
        raise ValueError("split is train, val or test")
    cut = {"train": 2, "val": 1, "test": 0}[split]
    own = seqs.withColumn(seq, F.slice(seq, F.lit(1), F.greatest(F.size(seq) - cut, F.lit(0))))
    if split == "train":
        return prefix_windows(own, most, seq).drop("target_pos")
    return last_window(own.where(F.size(seq) > 1), most, seq).drop(seq)


def dataset_stats(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """n_users and n_items count the pad, and the average length divides by that padded count."""
    items = seqs.select(F.explode(seq).alias("item")).agg(F.count_distinct("item").alias("n_items"))
    users = seqs.agg(F.count(F.lit(1)).alias("n_users"), F.sum(F.size(seq)).alias("n_interactions"))
    return users.crossJoin(items).select(
        (F.col("n_users") + 1).alias("n_users"),
        (F.col("n_items") + 1).alias("n_items"),
        "n_interactions",
        (F.col("n_interactions") / (F.col("n_users") + 1)).alias("avg_length"),
    )


def merge_categories(parts: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Several categories: interactions with users named category::user, and the sources of each item."""
    log = None
    for name, part in parts.items():
        one = part.withColumn("user", F.concat(F.lit(name), F.lit("::"), F.col("user"))).withColumn("source", F.lit(name))
        log = one if log is None else log.unionByName(one)
    return log, log.groupBy("item").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def known_items(meta: DataFrame, log: DataFrame, item: str = "item", order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """Metadata of items that occur in the log; of several records the last by (file, line) wins."""
    kept = meta.join(log.select(item).distinct(), item, "left_semi")
    last = kept.groupBy(item).agg(F.max_by(F.struct(*[c for c in meta.columns if c != item]), F.struct(*order)).alias("_r"))
    return last.select(item, "_r.*")


def unknown_items(meta: DataFrame, log: DataFrame, item: str = "item") -> DataFrame:
    """Items of the log that have no metadata."""
    return log.select(item).distinct().join(meta, item, "left_anti")


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two tables has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer").where("_l is null or _r is null")
    return both.select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))


def training_frequency(seqs: DataFrame, seq: str = "seq") -> DataFrame:
    """(item, n) over training prefixes: sequences without their last two items."""
    head = F.slice(seq, F.lit(1), F.greatest(F.size(seq) - 2, F.lit(0)))
    return seqs.select(F.explode(head).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
