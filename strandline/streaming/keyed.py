"""User sequences by keyed state: a stream is read once, and reading the sequences sorts no events.

Each trigger appends to a log, for every user it touched, the tail of the user's sequence: (user, version, start, late,
events). It says that from place ``start`` on the sequence is ``events``. State holds the events of a user that later ones
may still come before, those within ``horizon`` of the user's latest, and how many are settled before them; so it grows
with the horizon and not with the history. An event that comes before a settled one is not dropped: it is logged
as late, and only users with such an event are sorted again when the log is read.

With ``idle``, users without new events for that long have what is left settled by a timer. A query with such timers goes on
for ever, as the engine looks for expired ones, so it is not for a trigger that ends when all files are read.

Null times count as the least one, ties go by ``ord`` and then by item; equal events all stay. A row without a user is
a user of its own, null."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "struct<ts: double, ord: long, item: string>"
LOG = f"user string, version long, start long, late boolean, events array<{EVENT}>"
LEAST = float("-inf")


class TailProcessor(StatefulProcessor):
    def __init__(self, horizon: float, idle: timedelta | None = None, row_events: int = 10_000):
        self.horizon, self.idle, self.row_events = horizon, idle, row_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "ts double, ord long, item string")
        # settled events, triggers so far, and the last settled event
        self.head = handle.getValueState("head", "start long, version long, ts double, ord long, item string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for f in rows for r in f[["ts", "ord", "item"]].itertuples(index=False)]
        start, version, *last = self.head.get() if self.head.exists() else (0, 0, None, None, None)
        settled = None if last[1] is None else tuple(last)
        late = [] if settled is None else sorted(e for e in new if e < settled)
        kept = new if settled is None else [e for e in new if e >= settled]
        events = sorted([tuple(e) for e in self.open.get()] + kept)
        yield from self._rows(key, version, 0, late, True)
        yield from self._rows(key, version, start, events, False)
        # ties in time with the bound stay open: one of a smaller ord may still come
        bound = events[-1][0] - self.horizon if events else LEAST
        ready = sum(e[0] < bound for e in events)
        self._settle(events, ready, start, version + 1, settled)
        if self.idle is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if len(events) > ready:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle.total_seconds() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the log has the tail already, so there is nothing to say
        if self.open.exists():
            events = sorted(tuple(e) for e in self.open.get())
            start, version, *last = self.head.get()
            self._settle(events, len(events), start, version, tuple(last))
        return iter(())

    def _settle(self, events: list[tuple], ready: int, start: int, version: int, settled: tuple | None) -> None:
        if ready < len(events):
            self.open.put(events[ready:])
        else:
            self.open.clear()
        self.head.update((start + ready, version, *(events[ready - 1] if ready else settled or (None, None, None))))

    def _rows(self, key, version: int, start: int, events: list[tuple], late: bool) -> Iterator[pd.DataFrame]:
        for a in range(0, len(events), self.row_events):
            part = [{"ts": t, "ord": o, "item": i} for t, o, i in events[a : a + self.row_events]]
            yield pd.DataFrame({"user": [key[0]], "version": [version], "start": [start + a], "late": [late], "events": [part]})

    def close(self) -> None:
        pass


def with_keyed_state(spark: SparkSession) -> None:
    """The state store that keyed state needs, for streams that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def tails(stream: DataFrame, user: str, item: str, ts: str, ord: str, horizon: float, idle: timedelta | None = None) -> DataFrame:
    """The log of a stream of events, as a stream; ``horizon`` is in the unit of ts (seconds for timestamps).

    Rows without an item carry no event and are left out."""
    with_keyed_state(stream.sparkSession)
    time = F.col(ts)
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):  # seconds by the clock, whatever the session's zone
        gap = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        time = F.extract(F.lit("DAY"), gap) * 86400 + F.extract(F.lit("HOUR"), gap) * 3600 + F.extract(F.lit("MINUTE"), gap) * 60 + F.extract(F.lit("SECOND"), gap)
    time = time.cast("double")
    time = F.when(time.isNull() | F.isnan(time), F.lit(LEAST)).otherwise(time)
    rows = stream.where(F.col(item).isNotNull()).select(
        F.col(user).cast("string").alias("user"), time.alias("ts"), F.coalesce(F.col(ord).cast("long"), F.lit(0)).alias("ord"), F.col(item).cast("string").alias("item")
    )
    return rows.groupBy("user").transformWithStateInPandas(TailProcessor(horizon, idle), LOG, "Append", "None" if idle is None else "ProcessingTime")


def sequences_of(log: DataFrame) -> DataFrame:
    """(user, seq) of a log: what each row says up to where a later one begins, joined in order.

    A later version never begins before an earlier one, so this is a running minimum over rows of the log, of which a user has
    one a trigger and not one an event."""
    after = Window.partitionBy("user").orderBy("version", "start").rowsBetween(1, Window.unboundedFollowing)
    tail = log.where("not late").withColumn("until", F.min("start").over(after))
    valid = F.when(F.col("until").isNull(), F.col("events")).otherwise(F.slice("events", 1, F.greatest(F.col("until") - F.col("start"), F.lit(0)).cast("int")))
    rows = tail.select("user", "start", F.lit(False).alias("late"), valid.alias("events")).where(F.size("events") > 0)
    rows = rows.unionByName(log.where("late").select("user", "start", "late", "events"))
    parts = F.array_sort(F.collect_list(F.struct("late", "start", "events")))
    one = rows.groupBy("user").agg(parts.alias("parts"), F.max("late").alias("late"))
    flat = F.flatten(F.transform("parts", lambda p: p["events"]))
    return one.select("user", F.transform(F.when(F.col("late"), F.array_sort(flat)).otherwise(flat), lambda e: e["item"]).alias("seq"))


def read_log(spark: SparkSession, table: str) -> DataFrame:
    """The log that ``append_batches`` wrote of ``tails``."""
    return spark.read.schema(LOG).parquet(table)
