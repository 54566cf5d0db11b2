"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as a table read from Parquet, and returns a DataFrame; all
but the last return the columns of documents. run() applies them to the documents of a folder.

What holds for every stage: a null text counts as an empty one; extra columns, whatever their names, are carried along (the
last stage ignores them); an empty table gives an empty result; texts are taken whole, however long; rows with a
null doc_id are documents like others. What is a tie, and what becomes of rows that repeat both doc_id and
text, each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from strandline.llm.common import discard, read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Rows that repeat are judged alike, each for itself; without any reference language
    in the table only the base rules hold. Empty texts fail the base rules."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, a null doc_id losing to any other; of rows that repeat
    doc_id and text one stays, of which the first by no defined order where other columns differ."""
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays; rows equal in doc_id and text count as one."""
    return near_dedup.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole passes, none of them more than twice. A null source is a source of
    its own; documents without a word are never taken; rows equal in doc_id and text are taken alike."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a document that comes twice is packed twice."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: The packing stage runs a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, docs)  # of scratch tables only; the documents of the folder are none
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
