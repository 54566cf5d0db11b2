"""Sequences by keyed state against sorting all events at once."""

import datetime
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.streaming import keyed
from strandline.streaming.sequences import append_batches

SCHEMA = "u string, i string, t double, n long"


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, place, horizon):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    append_batches(keyed.tails(stream, "u", "i", "t", "n", horizon), f"{place}/log", f"{place}/progress").awaitTermination()
    return keyed.read_log(spark, f"{place}/log")


def found(log):
    return {r["user"]: r["seq"] for r in keyed.sequences_of(log).collect()}


def expected(rows):
    out = {}
    for u, i, t, n in rows:
        if i is not None:
            out.setdefault(u, []).append((float("-inf") if t is None or t != t else t, n or 0, i))
    return {u: [i for _, _, i in sorted(events)] for u, events in out.items()}


def test_a_late_batch_and_a_restart_equal_the_batch_result(spark, tmp_path):
    first = [("a", "x", 1.0, 1), ("a", "y", 9.0, 2), ("b", "z", 5.0, 1), ("a", "v", 10.0, 1)]
    late = [("a", "early", 0.5, 1), ("a", "w", 9.5, 1), ("b", "q", 4.0, 1), ("c", "only", None, None)]
    add_file(spark, f"{tmp_path}/in", first)
    assert found(run(spark, tmp_path, 2.0)) == expected(first)
    add_file(spark, f"{tmp_path}/in", late)
    log = run(spark, tmp_path, 2.0)  # goes on from the checkpoint
    assert found(log) == expected(first + late)
    # only what came before a settled event was logged as late
    assert [e["item"] for r in log.where("late").collect() for e in r["events"]] == ["early"]
    # the settled event is in the log once
    assert sum(e["item"] == "x" for r in log.collect() for e in r["events"]) == 1
    assert run(spark, tmp_path, 2.0).count() == log.count()  # nothing new, nothing logged


@pytest.mark.parametrize("horizon", [0.0, 3.0, 100.0])
def test_any_order_of_files_gives_the_same_sequences(spark, tmp_path, horizon):
    rng = random.Random(horizon)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"i{rng.randrange(6)}", rng.choice([None, float("nan"), *map(float, range(20))]), rng.choice([None, 0, 1])) for _ in range(120)]
    rows += [("b", None, 3.0, 1), *rows[:5]]
    for k in range(4):
        add_file(spark, f"{tmp_path}/in", rows[k::4])
    assert found(run(spark, tmp_path, horizon)) == expected(rows)


def test_long_tails_take_several_rows(spark):
    class Store:
        def __init__(self, value=None):
            self.value = value

        exists, get, put, update = (lambda s: s.value is not None), (lambda s: s.value or []), (lambda s, v: setattr(s, "value", v)), (lambda s, v: setattr(s, "value", v))

        def clear(self):
            self.value = None

    class Handle:
        listTimers, deleteTimer, registerTimer = (lambda s: []), (lambda s, x: None), (lambda s, x: None)

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 0

    p = keyed.TailProcessor(5.0, datetime.timedelta(hours=1), row_events=4)
    p.handle, p.open, p.head = Handle(), Store(), Store()
    out, rows = [], [("u", f"i{k}", float(k), 0) for k in range(30)]
    for part in (rows[:12], rows[12:24], rows[24:]):
        frame = pd.DataFrame({"ts": [r[2] for r in part], "ord": 0, "item": [r[1] for r in part]})
        out += [f.iloc[0].to_dict() for f in p.handleInputRows(("u",), iter([frame]), Clock())]
    assert len(p.open.value) == 6 and max(len(r["events"]) for r in out) == 4
    p.handleExpiredTimer(("u",), Clock(), None)
    assert p.open.value is None and p.head.value[0] == 30
    log = spark.createDataFrame([(r["user"], r["version"], r["start"], r["late"], [(e["ts"], e["ord"], e["item"]) for e in r["events"]]) for r in out], keyed.LOG)
    assert found(log) == expected(rows)


def test_an_empty_log_has_no_sequences(spark):
    assert keyed.sequences_of(spark.createDataFrame([], keyed.LOG)).count() == 0
    assert keyed.sequences_of(spark.createDataFrame([], keyed.LOG).withColumn("seq", F.lit(1))).columns == ["user", "seq"]


def test_a_timer_settles_idle_users(spark, tmp_path):
    first, later = [("a", "x", 5.0, 1), ("a", "y", 6.0, 1)], [("a", "early", 5.5, 1), ("b", "z", 1.0, 1)]
    add_file(spark, f"{tmp_path}/in", first)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    rows = keyed.tails(stream, "u", "i", "t", "n", 100.0, idle=datetime.timedelta(milliseconds=200))
    query = append_batches(rows, f"{tmp_path}/log", f"{tmp_path}/progress", trigger_once=False)

    def wait(done):
        end = time.monotonic() + 40
        while time.monotonic() < end and not done():
            assert query.exception() is None
            time.sleep(0.3)
        assert done()

    def logged():
        done = sum(1 for _ in (tmp_path / "log").glob("batch=*/_SUCCESS")) if (tmp_path / "log").exists() else 0
        return done, keyed.read_log(spark, f"{tmp_path}/log").agg(F.sum(F.size("events"))).first()[0] if done else 0

    try:
        wait(lambda: logged()[1] == 2)
        batches = logged()[0]
        wait(lambda: logged()[0] >= batches + 4)  # batches without data look for timers
        add_file(spark, f"{tmp_path}/in", later)
        wait(lambda: logged()[1] == 4)
    finally:
        query.stop()
    log = keyed.read_log(spark, f"{tmp_path}/log")
    # within the horizon, yet late: the timer had settled the user
    assert [e["item"] for r in log.where("late").collect() for e in r["events"]] == ["early"]
    assert found(log) == expected(first + later)
