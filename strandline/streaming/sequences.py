"""User sequences kept up to date from a stream of events.

The stream is a file source; each micro-batch is appended as positions-free interactions keyed by batch, so a
batch that runs again after a failure replaces its own files and nothing else. Reading builds the sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def append_batches(stream: DataFrame, table: str, checkpoint: str, trigger_once: bool = True):
    """Start a query that writes each batch to table/batch=N; returns the streaming query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger_once else writer).start()


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and keys; events later than the watermark are dropped by the engine."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *keys, "n")


def current_sequences(spark: SparkSession, table: str, user: str, item: str, order: tuple[str, ...]) -> DataFrame:
    from strandline.operators.interactions import sequences

    return sequences(spark.read.parquet(table), user, item, order)
