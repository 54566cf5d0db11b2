"""Model examples: encoded history, label atoms, masks and padding, and statistics of merge paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.operators.vocabulary import Vocabulary

IGNORE = -100


def distinct_states(items: DataFrame, feats: str = "feats") -> DataFrame:
    """The distinct code tuples: paths are made once for each, and joined back."""
    return items.select(feats).distinct()


def merge_paths(items: DataFrame, vocab: Vocabulary, feats: str = "feats") -> DataFrame:
    """(feats, path): all stages from atoms to full merging, of every distinct tuple."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({feats: pdf[feats], "path": [vocab.merge_path(vocab.state(f)) for f in pdf[feats]]})

    return distinct_states(items, feats).mapInPandas(run, f"{feats} array<int>, path array<array<int>>")


def path_report(paths: DataFrame) -> DataFrame:
    """(stages, n): how many tuples have paths of so many stages."""
    return paths.groupBy(F.size("path").cast("long").alias("stages")).agg(F.count(F.lit(1)).alias("n"))


def path_summary(paths: DataFrame) -> DataFrame:
    last = F.size(F.element_at("path", -1))
    return paths.agg(
        F.count(F.lit(1)).alias("n_states"), F.count_if(F.size("path") > 1).alias("n_several"), F.avg(F.size("path")).alias("mean_stages"), F.avg(last).alias("mean_final_length")
    )


def history_tokens(paths: DataFrame, policy: str, key: list[str], seed: int = 2024) -> DataFrame:
    """paths (with key columns) with tokens: the stage that a policy picks. ``random`` depends on the seed and
    the key alone, not on targets, batches or order. Inside the JVM."""
    n = F.size("path")
    at = {
        "raw": F.lit(1),
        "full": n,
        "middle": (F.floor((n - 1) / 2) + 1).cast("int"),
        "random": (F.pmod(F.xxhash64(F.lit(seed), *key), n) + 1).cast("int"),
    }
    if policy not in at:
        raise ValueError(f"unknown policy {policy}")
    return paths.withColumn("tokens", F.element_at("path", at[policy]))


def label_atoms(items: DataFrame, vocab: Vocabulary, feats: str = "feats") -> DataFrame:
    """items with label: the target's atoms in slot order. The atoms' tokens are a map literal (bounded by the code books)."""
    table = F.create_map(*[x for (slot, code), t in sorted(vocab.index.items()) for x in (F.lit(slot * 1_000_000 + code), F.lit(t))])
    return items.withColumn("label", F.transform(F.col(feats), lambda c, k: F.element_at(table, k * 1_000_000 + c)))


def assemble(rows: DataFrame, width: int, label_width: int, bos: int, eos: int, control: list[int] | None = None, items: str = "n_items") -> DataFrame:
    """rows (tokens, label) with input_ids, attention_mask and labels of fixed widths.

    Inputs are BOS, tokens, a control suffix once for each item, EOS, right padded with 0; labels end with EOS
    and are padded with IGNORE. Longer inputs raise, they are never cut."""
    tail = C.control_suffix(items, control) if control else F.array().cast("array<int>")
    full = F.concat(F.array(F.lit(bos)), F.col("tokens"), tail, F.array(F.lit(eos)))
    checked = F.when(F.size(full) > width, F.raise_error(F.lit("an input is wider than the batch")).cast("array<int>")).otherwise(full)
    out = rows.withColumn("_ids", checked).withColumn("_label", F.concat("label", F.array(F.lit(eos))))
    out = out.withColumn("input_ids", C.right_padded("_ids", width)).withColumn("attention_mask", C.attention_mask("_ids", width))
    return out.withColumn("labels", C.right_padded("_label", label_width, IGNORE)).drop("_ids", "_label")


def padded_label(label: str, width: int, eos: int):
    """The labels of ``assemble``, which an item has wherever it is the target."""
    return C.right_padded(F.concat(label, F.array(F.lit(eos))), width, IGNORE)


def spelt(tokens: str):
    """Tokens as text; null where there are none, which no list of texts shows."""
    return F.nullif(F.array_join(tokens, " "), F.lit(""))


def assemble_texts(rows: DataFrame, width: int, bos: int, eos: int) -> DataFrame:
    """rows (texts: the ``spelt`` tokens of the items of the history, counts: how many each has) with input_ids and attention_mask
    of ``assemble``, joined by spaces: no token is handled for itself, so examples that share items cost no more than their text."""
    n = F.aggregate("counts", F.lit(2), lambda a, x: a + x)
    out = rows.withColumn("_n", F.when(n > width, F.raise_error(F.lit("an input is wider than the batch")).cast("int")).otherwise(n))
    pad = F.repeat(F.lit(" 0"), width - F.col("_n"))
    out = out.withColumn("input_ids", F.concat(F.concat_ws(" ", F.lit(str(bos)), F.array_compact("texts"), F.lit(str(eos))), pad))
    return out.withColumn("attention_mask", F.concat(F.lit("1"), F.repeat(F.lit(" 1"), F.col("_n") - 1), pad)).drop("_n")


