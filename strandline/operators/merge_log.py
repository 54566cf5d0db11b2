"""Analysis of merge logs: compositions, transitions, phases, exposure and the exact slot permutation test.

A log has a row per merge: step, new_token, left and right (operand tokens), left_rule and right_rule (the
(slot, code) pair of an operand that is an atom), slots (of the new token), priority and affected."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import codes as C

SCHEMA = (
    "event string, step int, new_token int, left int, right int, left_rule array<int>, right_rule array<int>, "
    "slots array<int>, priority double, affected_sequences double"
)
PURE = ["text_text", "image_image", "text_image"]
FUSION = ["text_image", "mixed_text", "mixed_image", "mixed_mixed"]


def merges(log: DataFrame) -> DataFrame:
    """The merge events that can be classified."""
    return log.where((F.col("event") == "merge") & F.col("slots").isNotNull() & F.col("new_token").isNotNull())


def with_operands(log: DataFrame) -> DataFrame:
    """log with left_slots and right_slots: those of the record that made the operand, if it came earlier,
    else the slot of the operand's own rule if that is an atom's; null where neither is known."""
    made = log.select(F.col("new_token").alias("_t"), F.col("step").alias("_s"), F.col("slots").alias("_slots"))
    out = log
    for side in ("left", "right"):
        src = made.select(F.col("_t").alias(f"_{side}_t"), F.col("_s").alias(f"_{side}_s"), F.col("_slots").alias(f"_{side}_slots"))
        out = out.join(src, (F.col(side) == F.col(f"_{side}_t")) & (F.col(f"_{side}_s") < F.col("step")), "left")
        atom = F.when(F.size(f"{side}_rule") == 2, F.array(F.get(F.col(f"{side}_rule"), 0)))
        out = out.withColumn(f"{side}_slots", F.coalesce(f"_{side}_slots", atom)).drop(f"_{side}_t", f"_{side}_s", f"_{side}_slots")
    return out


def classified(log: DataFrame, text: list[int], image: list[int], hash_slot: int = -1) -> DataFrame:
    """log with output (composition label), transition and includes_hash."""
    rows = with_operands(merges(log))
    kind = lambda c: F.when(F.col(c).isNotNull(), C.composition(c, text, image, hash_slot))
    hashed = lambda c: F.coalesce(C.has_hash(c, hash_slot), F.lit(False))
    # columns of their own, so that the nested cases refer to values and not to copies of expressions
    rows = rows.select(
        "*", C.composition("slots", text, image, hash_slot).alias("_o"), kind("left_slots").alias("_l"), kind("right_slots").alias("_r"),
        hashed("slots").alias("includes_hash"), hashed("left_slots").alias("_lh"), hashed("right_slots").alias("_rh"),
    )
    rows = rows.withColumn("output", C.output_label("_o")).withColumn("transition", C.transition("_l", "_r", F.col("_lh"), F.col("_rh")))
    return rows.drop("_o", "_l", "_r", "_lh", "_rh")


def output_composition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("output").agg(
        F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priority"), F.sum("affected_sequences").alias("affected"), F.count_if("includes_hash").alias("n_hash")
    )


def transition_composition(rows: DataFrame) -> DataFrame:
    return rows.groupBy("transition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priority"), F.sum("affected_sequences").alias("affected"), F.min("step").alias("first_step")
    )


def phases(rows: DataFrame, bins: int) -> DataFrame:
    """(bin, phase_group, n, priority); bins count from 1."""
    last = rows.agg(F.max("step").alias("_last"))  # one row
    at = C.phase("step", F.col("_last"), bins) + 1
    grouped = rows.crossJoin(F.broadcast(last)).withColumn("bin", at).withColumn("phase_group", C.phase_group("transition"))
    return grouped.groupBy("bin", "phase_group").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("priority"))


def exposure(log: DataFrame) -> DataFrame:
    """Selections against candidates by kind. log: selected, counts and masses (maps by kind), one row per step.

    (kind, selected, expected_by_count, count_enrichment, expected_by_mass, mass_enrichment)"""
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    rows = log.withColumn("_c", total("counts")).withColumn("_m", total("masses")).where("_c > 0 and _m > 0")
    shares = [
        rows.select(F.explode("counts").alias("kind", "x"), "_c").select("kind", (F.greatest("x", F.lit(0.0)) / F.col("_c")).alias("by_count"), F.lit(0.0).alias("by_mass"), F.lit(0).alias("sel")),
        rows.select(F.explode("masses").alias("kind", "x"), "_m").select("kind", F.lit(0.0).alias("by_count"), (F.greatest("x", F.lit(0.0)) / F.col("_m")).alias("by_mass"), F.lit(0).alias("sel")),
        rows.select(F.col("selected").alias("kind"), F.lit(0.0).alias("by_count"), F.lit(0.0).alias("by_mass"), F.lit(1).alias("sel")),
    ]
    every = shares[0].unionByName(shares[1]).unionByName(shares[2])
    out = every.groupBy("kind").agg(F.sum("sel").alias("selected"), F.sum("by_count").alias("expected_by_count"), F.sum("by_mass").alias("expected_by_mass"))
    return out.withColumn("count_enrichment", C.ratio("selected", "expected_by_count")).withColumn("mass_enrichment", C.ratio("selected", "expected_by_mass"))


def candidate_exposure(totals: DataFrame, kind: Column) -> DataFrame:
    """Candidate pairs by kind: how many, their mass and the largest."""
    return totals.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), F.max("mass").alias("largest"))


def partitions(slots: list[int], size: int) -> list[tuple[int, ...]]:
    """All labelled choices of the text slots: 70 for four of eight."""
    return list(combinations(sorted(slots), size))


def slot_permutation_test(log: DataFrame, text: list[int], image: list[int], hash_slot: int = -1) -> DataFrame:
    """Three rates of the real boundary against every equal-size labelling of the semantic slots.

    One pass: each merge meets every partition (at most C(16, 8) rows, broadcast), slots become bit masks, and
    classes follow from masks. (metric, observed, null_mean, null_std, null_min, null_max, enrichment, z_score,
    p_greater_equal, p_less_equal, p_two_sided)"""
    if len(text) != len(image):
        raise ValueError("both sides need equally many slots")
    spark = log.sparkSession
    slots = sorted([*text, *image])
    if len(slots) > 16:
        raise ValueError("at most 16 semantic slots")
    mask = lambda ss: sum(1 << s for s in ss)
    whole, real = mask(slots), mask(text)
    table = spark.createDataFrame([(mask(p), whole & ~mask(p)) for p in partitions(slots, len(text))], "t long, i long")
    bits = lambda c: F.aggregate(F.col(c), F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(F.expr("1L").bitwiseOR(F.lit(0)) * F.pow(F.lit(2.0), s).cast("long")))
    rows = with_operands(merges(log)).select(bits("slots").alias("o"), bits("left_slots").alias("l"), bits("right_slots").alias("r"))
    rows = rows.groupBy("o", "l", "r").agg(F.count(F.lit(1)).alias("n"))  # merges of equal slots count together
    hashed = 1 << hash_slot if hash_slot >= 0 else 0
    outside = ~(whole | hashed)

    def kind(c: str) -> Column:
        m = F.col(c)
        t, i = m.bitwiseAND(F.col("t")) != 0, m.bitwiseAND(F.col("i")) != 0
        base = F.when(t & i, "mixed").when(t, "text").when(i, "image").otherwise("unknown")
        return F.when(m.isNull() | (m.bitwiseAND(F.lit(outside)) != 0), "unknown").when(m.bitwiseAND(F.lit(hashed)) != 0, "hash").otherwise(base)

    at = rows.crossJoin(F.broadcast(table)).withColumn("a", kind("l")).withColumn("b", kind("r"))
    out_t, out_i = F.col("o").bitwiseAND(F.col("t")) != 0, F.col("o").bitwiseAND(F.col("i")) != 0
    at = at.withColumn("tr", C.transition("a", "b", F.col("a") == "hash", F.col("b") == "hash"))
    out_mixed = out_t & out_i & (F.col("o").bitwiseAND(F.lit(outside)) == 0)
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    rates = at.groupBy("t").agg(
        C.ratio(count(F.col("tr") == "text_image"), count(F.col("tr").isin(PURE))).alias("direct_cross_rate_among_pure"),
        C.ratio(count(F.col("tr").isin(FUSION)), count(F.col("tr").isin([*PURE, *FUSION]))).alias("fusion_rule_rate_no_hash"),
        C.ratio(count(out_mixed), F.sum("n")).alias("output_mixed_rate"),
    )
    flat = rates.unpivot(["t"], ["direct_cross_rate_among_pure", "fusion_rule_rate_no_hash", "output_mixed_rate"], "metric", "value")
    return null_summary(flat.withColumn("real", F.col("t") == real), "metric", "value", "real")


def null_summary(values: DataFrame, key: str, value: str, real: str) -> DataFrame:
    """Observed value against all values of a key, the real one among them (it has real = true)."""
    one = values.groupBy(key).agg(
        F.max(F.when(F.col(real), F.col(value))).alias("observed"),
        F.avg(value).alias("null_mean"),
        F.stddev_pop(value).alias("null_std"),
        F.min(value).alias("null_min"),
        F.max(value).alias("null_max"),
        F.count(F.lit(1)).alias("_n"),
    )
    eps = 1e-12
    back = values.select(key, value).join(one.select(key, "observed", "null_mean"), key)
    p = back.groupBy(key).agg(
        F.count_if(F.col(value) >= F.col("observed") - eps).alias("_ge"),
        F.count_if(F.col(value) <= F.col("observed") + eps).alias("_le"),
        F.count_if(F.abs(F.col(value) - F.col("null_mean")) >= F.abs(F.col("observed") - F.col("null_mean")) - eps).alias("_two"),
    )
    return one.join(p, key).select(
        key, "observed", "null_mean", "null_std", "null_min", "null_max",
        C.ratio("observed", "null_mean").alias("enrichment"),
        C.ratio(F.col("observed") - F.col("null_mean"), "null_std").alias("z_score"),
        C.ratio("_ge", "_n").alias("p_greater_equal"), C.ratio("_le", "_n").alias("p_less_equal"), C.ratio("_two", "_n").alias("p_two_sided"),
    )
