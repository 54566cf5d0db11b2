"""Substring deduplication by hashing of lines, paragraphs, sentences or clauses.

Texts are cut into units (a sentence or clause ends with its line at the latest, so that repeated lines are
runs of repeated clauses, and the blanks behind it belong to it), units are normalised (case folded, white
space runs to one space) and digested where the text is read; only numbers and digests are shuffled. Per digest
the earliest occurrence by (doc_id, row, place) is kept, found by a partial aggregation, so a unit that stands in
a third of all documents costs one row per task. A later occurrence goes if it is part of a run: neighbouring
units of one document, all of them later occurrences, with ``min_run`` words or more together. Short common
phrases form no run and stay; the earliest occurrence of every unit stays in any case, so no unit is lost
altogether. ``min_run=1``, the default, removes every later occurrence. Each document keeps the offsets (in code points) of
what it lost.

Runs are found by a window over the repeated units of a document, which may spill; what is gathered in a row
is one span per run, less than the text that stands in the same row.

Defined results for odd input: a null text is an empty one; a null doc_id ranks as the largest number;
pieces without a word, or with fewer than min_words, are no units: they never go and end no run; rows that repeat a doc_id are separate documents, ranked by an internal row
number next; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, repeatable, stored

SPLITS = {"line": "\n", "paragraph": "\n\n"}
MIN_WORDS = 1
MIN_RUN = 30
PIECE = 256
_CLOSE = "[\"'»“”’)\\]]*\\s+"
_ENDS = {
    "sentence": re.compile(r"[.!?…]+" + _CLOSE + r"|[。！？]+[」』]*\s*"),
    "clause": re.compile(r"[.!?…,;:]+" + _CLOSE + r"|[。！？，、；：]+[」』]*\s*"),
}


def _normal(unit: str) -> str:
    return " ".join(unit.casefold().split())


def unit_spans(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """(start, end) of each unit, without its separator; sentences and clauses include the blanks behind them."""
    if unit in _ENDS:
        out = []
        for a, b in unit_spans(text):
            cuts = [m.end() for m in _ENDS[unit].finditer(text, a, b)]
            out += zip([a, *cuts], [*cuts, b], strict=True)
        return [(a, b) for a, b in out if a < b]
    sep, out, at = SPLITS[unit], [], 0
    for x in text.split(sep):
        out.append((at, at + len(x)))
        at += len(x) + len(sep)
    return out


def counted_units(text: str, unit: str, min_words: int):
    """(start, end, words of the normalised unit) of the units that count; their place in this list is their number."""
    for a, b in unit_spans(text, unit):
        words = text[a:b].casefold().split()
        if len(words) >= max(min_words, 1):
            yield a, b, words


def _pieces(batches):
    """Slices of few rows, so that a worker holds the units of few documents as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE):
            yield batch.slice(a, PIECE)


def _units(unit: str, min_words: int):
    def run(batches):
        for batch in _pieces(batches):
            pick, number, words, digests = [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, (_, _, w) in enumerate(counted_units(text or "", unit, min_words)):
                    pick.append(k)
                    number.append(n)
                    words.append(len(w))
                    digests.append(hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(pick, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number, pa.int32()), pa.array(words, pa.int32()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                names=["doc", "_row", "number", "words", "d1", "d2"],
            )

    return run


def _cut(unit: str, min_words: int):
    """Text and its runs of unit numbers -> what is left, the spans that go, and how much is repeated at all."""

    def run(batches):
        for batch in _pieces(batches):
            left, lost, repeated, gone, spans = [], [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                text, at, keep, own, twice = text or "", 0, [], [], 0
                places = list(counted_units(text, unit, min_words)) if found else []
                for r in sorted(found or [], key=lambda r: r["first"]):
                    a, b = places[r["first"]][0], places[r["last"]][1]
                    if not r["later"]:
                        twice += b - a
                        continue
                    for a, b, _ in places[r["first"] : r["last"] + 1]:
                        keep.append(text[at:a])
                        own.append({"start": a, "end": b})
                        at = b
                keep.append(text[at:])
                left.append("".join(keep))
                lost.append(len(text) - len(left[-1]))
                repeated.append(twice)
                gone.append(len(own))
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(left, pa.string()), pa.array(lost, pa.int64()), pa.array(repeated, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)],
                names=["doc_id", "kept_text", "n_removed_chars", "n_repeated_chars", "n_units_removed", "spans"],
            )

    return run


def repeated_runs(units: DataFrame, min_run: int) -> DataFrame:
    """_row and its runs (first, last unit number, later) of min_run words or more: runs of repeated units of any
    rank, and runs of later occurrences only."""
    rank = F.struct("doc", "_row", "number")
    first = units.groupBy("d1", "d2").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table of its own: else its grouping would also deal the rows of the join, common units and all
    first = stored(first.select("d1", "d2", F.col("least._row").alias("first_row"), F.col("least.number").alias("first_number")), "unit-first")
    # both sides sorted at every size, as a table of repeated digests that happens to fit a broadcast does not for long
    again = units.select("_row", "number", "words", "d1", "d2").join(first.hint("merge"), ["d1", "d2"])
    again = again.select("_row", "number", "words", ((F.col("_row") != F.col("first_row")) | (F.col("number") != F.col("first_number"))).alias("later"))
    w = Window.partitionBy("_row").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # numbers without a gap differ from their count by a constant
    any_run, later_run = (F.col("number") - F.sum(x).over(w) for x in (F.lit(1), F.col("later").cast("int")))
    member = [F.struct(F.lit(kind).alias("kind"), run.cast("long").alias("run")) for kind, run in ((False, any_run), (True, later_run))]
    parts = again.select("_row", "number", "words", F.when(F.col("later"), F.array(*member)).otherwise(F.array(member[0])).alias("member"))
    parts = parts.select("_row", "number", "words", F.inline("member")).withColumnRenamed("kind", "later")
    runs = parts.groupBy("_row", "later", "run").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.sum("words").alias("words"))
    out = stored(runs.where(F.col("words") >= min_run).groupBy("_row").agg(F.collect_list(F.struct("first", "last", "later")).alias("runs")), "unit-runs")
    discard(units.sparkSession, first)
    return out


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS, min_run: int = 1) -> DataFrame:
    """One row per document: doc_id, kept_text, n_removed_chars, n_repeated_chars (characters in runs that stand
    elsewhere too, earliest occurrences included), n_units_removed, spans (array of start, end)."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a row number that is the same in both passes: rows of one file split come in file order
    base = repeatable(base).withColumn("_row", F.monotonically_increasing_id())
    rank = F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc")
    units = stored(base.select(rank, "_row", "text").mapInArrow(_units(unit, min_words), "doc long, _row long, number int, words int, d1 long, d2 long"), "units")
    runs = repeated_runs(units, min_run)
    discard(spark, units)
    gc.collect()
    spark._jvm.System.gc()  # lets Spark delete the shuffle files of plans that are done with
    joined = base.join(runs.hint("merge"), "_row", "left").select("doc_id", "text", "runs")
    kinds = "doc_id long, kept_text string, n_removed_chars long, n_repeated_chars long, n_units_removed long, spans array<struct<start: long, end: long>>"
    return joined.mapInArrow(_cut(unit, min_words), kinds)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_units(read(spark, sf_dir, "documents"), "clause", min_run=MIN_RUN)
    return out.select(
        "doc_id",
        "n_units_removed",
        "n_removed_chars",
        "n_repeated_chars",
        F.length("kept_text").cast("long").alias("n_kept_chars"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.col("spans").alias("removed_spans"),
    )


ORACLE_SQL = None
