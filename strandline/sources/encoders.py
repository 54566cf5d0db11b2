"""Encoding items with an external model that the caller supplies.

A factory is called once in each Python worker and returns a function from a list of inputs to vectors.
Progress is a folder per identity: batches of items that are there already are not encoded again, and a
folder made for another model, width or item order is refused."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrying(factory: Callable, attempts: int = 5, permanent: tuple = (ValueError, TypeError, PermissionError), longest: float = 8.0, sleep: Callable = time.sleep) -> Callable:
    """A factory whose function is called again after an error, with waits of 1, 2, 4 ... seconds up to longest; errors of
    the permanent kinds are raised at once, the last of the others after all attempts."""

    def made():
        call = factory()

        def again(rows):
            for k in range(attempts):
                try:
                    return call(rows)
                except permanent:
                    raise
                except Exception as e:
                    if k + 1 == attempts:
                        raise RuntimeError(f"no answer after {attempts} attempts") from e
                    sleep(min(2.0**k, longest))

        return again

    return made


def encode(items: DataFrame, factory: Callable, inputs: list[str], width: int, key: str = "item", batch: int = 64, on_missing: str = "zero") -> DataFrame:
    """(key, vec) with vectors cut to width and of unit length.

    factory() returns encode(rows: list[dict]) -> array-like; a row whose inputs are all null gets a zero
    vector, or is left out where on_missing is 'skip'."""

    def run(batches):
        model = factory()
        for pdf in batches:
            empty = pdf[inputs].isna().all(axis=1).to_numpy()
            out = np.zeros((len(pdf), width), np.float32)
            rows = np.flatnonzero(~empty)
            for a in range(0, len(rows), batch):
                at = rows[a : a + batch]
                x = np.asarray(model(pdf.iloc[at][inputs].to_dict("records")), np.float64)[:, :width]
                out[at] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            keep = np.ones(len(pdf), bool) if on_missing == "zero" else ~empty
            yield pd.DataFrame({key: pdf[key][keep], "vec": list(out[keep])})

    kind = dict(items.dtypes)[key]
    return items.select(key, *inputs).mapInPandas(run, f"{key} {kind}, vec array<float>")


def item_order_digest(items: DataFrame, key: str = "item", order: str = "id") -> str:
    """A digest of which item has which place, without gathering the items."""
    h = F.xxhash64(order, key).cast("decimal(38,0)")
    r = items.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), order, key)).alias("x")).first()
    return f"{r['n']}-{r['s']}-{r['x']}"


def encode_resumable(items: DataFrame, factory: Callable, inputs: list[str], width: int, folder: str, identity: dict, key: str = "item", order: str = "id", step: int = 100_000, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """Encode in ranges of ``order``, each committed as a folder of its own; a second call goes on where the
    first stopped. Raises if the folder belongs to another identity. progress is told how many ranges are done, of how many."""
    spark = items.sparkSession
    mine = json.dumps(identity | {"width": width, "item_order": item_order_digest(items, key, order)}, sort_keys=True)
    jvm = spark._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = at("identity").getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at("identity")):
        held = "\n".join(r[0] for r in spark.read.text(f"{folder}/identity").collect())
        if held != mine:
            a, b = json.loads(held), json.loads(mine)
            raise ValueError(f"the folder was made with another {', '.join(sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k)))}")
    else:
        spark.createDataFrame([(mine,)], "value string").coalesce(1).write.text(f"{folder}/identity")
    last = items.agg(F.max(order)).first()[0]
    for start in range(0, (last or 0) + 1, step):
        if not fs.exists(at(f"part={start}/_SUCCESS")):
            part = items.where((F.col(order) >= start) & (F.col(order) < start + step))
            encode(part, factory, inputs, width, key).write.mode("overwrite").parquet(f"{folder}/part={start}")
        if progress:
            progress(start // step + 1, (last or 0) // step + 1)
    return spark.read.parquet(*[f"{folder}/part={s}" for s in range(0, (last or 0) + 1, step)])
