"""Evaluation of ranked predictions: hits, discounted gain, invalid shares, fusion and length profiles.

Predictions are rows (example, rank, codes); ranks begin at 1, and an invalid prediction begins with -1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import codes as C

TOP_K = (5, 10, 20, 50)


def first_hits(preds: DataFrame, labels: DataFrame, eos: int | None = None) -> DataFrame:
    """(example, hit): the rank of the first prediction that equals the label, null if none does.

    labels: (example, label). A label is cut at its first end token. No ranking is sorted: the minimum of
    matching ranks is a partial aggregation."""
    label = C.until("label", eos) if eos is not None else F.col("label")
    truth = labels.select("example", label.alias("_label"))
    found = preds.join(truth, "example").where(F.col("codes") == F.col("_label")).groupBy("example").agg(F.min("rank").alias("hit"))
    return labels.select("example").join(found, "example", "left")


def metrics(preds: DataFrame, labels: DataFrame, ks=TOP_K, eos: int | None = None, by: str | None = None) -> DataFrame:
    """(metric, k, value): means over examples of recall, ndcg and err; by adds a column of labels to group by."""
    hits = first_hits(preds, labels, eos)
    bad = preds.where(F.get("codes", F.lit(0)) == -1).groupBy("example").agg(*[F.count_if(F.col("rank") <= k).alias(f"_bad{k}") for k in ks])
    rows = hits.join(bad, "example", "left")
    if by:
        rows = rows.join(labels.select("example", by), "example")
    measures = []
    for k in ks:
        hit = F.coalesce(F.col("hit") <= k, F.lit(False))
        measures += [
            F.avg(hit.cast("double")).alias(f"recall@{k}"),
            F.avg(F.when(hit, C.discount("hit")).otherwise(0.0)).alias(f"ndcg@{k}"),
            F.avg(F.coalesce(F.col(f"_bad{k}"), F.lit(0)) / k).alias(f"err@{k}"),
        ]
    grouped = rows.groupBy(by) if by else rows.groupBy()
    wide = grouped.agg(*measures)
    names = [f"{m}@{k}" for k in ks for m in ("recall", "ndcg", "err")]
    flat = wide.unpivot([by] if by else [], names, "name", "value")
    parts = F.split("name", "@")
    return flat.select(*([by] if by else []), parts[0].alias("metric"), parts[1].cast("int").alias("k"), "value")


def allowed_only(preds: DataFrame, allowed: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """Predictions whose (keys, codes) is allowed, first seen once, at most ``most`` of each example, ranked anew."""
    kept = preds.join(allowed, [*keys, "codes"], "left_semi")
    firsts = kept.groupBy("example", "codes").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("example").orderBy("rank")
    return firsts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("example", F.col("_r").alias("rank"), "codes")


def fuse_rankings(members: DataFrame, most: int) -> DataFrame:
    """Fusion of several rankings: (example, member, rank, codes) to (example, rank, codes).

    A valid prediction scores 1 / log2(rank + 1) in each member (its first place there counts); ties keep
    the order of first sight. Missing places are filled with invalid predictions by ``padded``."""
    valid = members.where(F.get("codes", F.lit(0)) != -1)
    once = valid.groupBy("example", "codes", "member").agg(F.min("rank").alias("rank"))
    scores = once.groupBy("example", "codes").agg(F.sum(C.discount("rank")).alias("score"), F.min(F.struct("member", "rank")).alias("seen"))
    w = Window.partitionBy("example").orderBy(F.desc(F.round("score", 12)), "seen")
    return scores.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("example", F.col("place").alias("rank"), "codes", "score")


def padded(preds: DataFrame, examples: DataFrame, most: int, width: int) -> DataFrame:
    """Every example with exactly ``most`` predictions, those missing invalid."""
    places = examples.select("example", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("rank"))
    return places.join(preds.select("example", "rank", "codes"), ["example", "rank"], "left").withColumn("codes", F.coalesce("codes", F.array_repeat(F.lit(-1), width)))


def length_profile(rows: DataFrame, length: str) -> DataFrame:
    """Mean, exact 95th percentile (linear interpolation), longest, and the padding share at that width."""
    return rows.agg(
        F.avg(length).alias("mean_length"), F.percentile(length, 0.95).alias("p95_length"), F.max(length).alias("max_length"),
        (1 - F.sum(length) / (F.max(length) * F.count(length))).alias("padding_fraction"),
    )


def length_gap(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Catalogue token lengths under two vocabularies and the rounded gap of their means (half to even)."""
    stats = []
    for c in (left, right):
        stats += [F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    out = rows.agg(*stats)
    return out.withColumn("gap", F.bround(F.col(f"{right}_mean") - F.col(f"{left}_mean"), 0).cast("int"))


def norm_report(vectors: DataFrame, vec: str) -> DataFrame:
    from strandline.functions import vectors as V

    return vectors.select(V.norm(vec).alias("n"), V.is_finite(vec).alias("f")).agg(
        F.min("n").alias("min_norm"), F.max("n").alias("max_norm"), F.count_if(F.col("n") == 0).alias("n_zero"), F.count_if(~F.col("f")).alias("n_not_finite")
    )


def usage_totals(log: DataFrame, usage: str = "usage") -> DataFrame:
    """(name, total) over the maps of a request log."""
    return log.select(F.explode(usage).alias("name", "x")).groupBy("name").agg(F.sum("x").alias("total"))


def examples_by_class(rows: DataFrame, cls: str, order: str, most: int = 3) -> DataFrame:
    """The first rows of every class; the planner prunes each partition before the shuffle."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(cls).orderBy(order))).where(F.col("_r") <= most).drop("_r")
