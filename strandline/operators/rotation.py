"""Rotated product quantisation and whitening, from sums over all vectors.

What passes through the driver are books, means and square matrices of the vectors' width, none of which grows with the number of
vectors: every pass over them runs in Arrow batches, sums in its task, and adds up the rows of the matrices in Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.item_codes import _nearest
from strandline.operators.tables import discarded, kept


#: How much the present rotation weighs against a mean singular value of the cross-covariance.
HOLD = 1e-6


def _stacked(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def _summed(vectors: DataFrame, make, rows: int, width: int) -> np.ndarray:
    """The sum over all batches of make(batch as rows of vectors), a matrix of rows x width. vectors: one column of arrays."""

    def run(batches):
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                total += make(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "part"])

    parts = vectors.mapInArrow(run, "row int, part array<double>").withColumn("part", array_to_vector("part"))
    out = np.zeros((rows, width))
    # one row for each of rows, whatever the number of tasks
    for r in parts.groupBy("row").agg(vector_to_array(Summarizer.sum(F.col("part"))).alias("total")).collect():
        out[r["row"]] = r["total"]
    return out


class RotatedQuantizer:
    """Codes of vectors after a rotation that makes them easy to quantise, as residuals from one coarse centroid.

    Rotation and codebooks take turns: given the rotation, every vector goes to its nearest centroids and these to the means of
    what they got; given the codes, the rotation that brings vectors closest to their centroids follows from the singular
    vectors of the cross-covariance of both (orthogonal Procrustes). Neither step can make the distortion worse. With the rotation
    fixed, the mean of the rotated vectors becomes the coarse centroid and books are trained on what is left of them.

    train: which vectors are trained on (all by default); all are encoded. The start are the vectors of least seeded hash, so
    runs agree. Null vectors take no part in training and get null codes; equal vectors count each; of centroids equally near the
    first is taken; a centroid that nothing is near to stays where it is."""

    def __init__(self, parts: int = 4, size: int = 256, turns: int = 10, rounds: int = 10, seed: int = 2024):
        self.parts, self.size, self.turns, self.rounds, self.seed = parts, size, turns, rounds, seed
        self.rotation: np.ndarray | None = None
        self.coarse: np.ndarray | None = None
        self.books: np.ndarray | None = None  # parts x size x width of a part

    def fit(self, vectors: DataFrame, vec: str = "vec", key: str = "id", train: Column | None = None) -> RotatedQuantizer:
        some = vectors if train is None else vectors.where(train)
        table = kept(some.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.xxhash64(F.lit(self.seed), key).alias("h")), "rotation")
        first = table.orderBy("h", "v").limit(self.size).select("v").collect()  # at most ``size`` rows
        if not first:
            raise ValueError("no vectors to train on")
        width = len(first[0][0]) // self.parts * self.parts
        start = np.array([r[0][:width] for r in first], float)
        data = table.select(F.slice("v", 1, width).alias("v"))
        self.rotation = np.eye(width)
        books = self._books(start)
        for _ in range(self.turns):
            books = self._moved(data, books, np.zeros(width))
            cross = self._cross(data, books, width)
            # centroids need not span all directions: those that they leave open stay as they are, else runs would not agree
            u, _, vt = np.linalg.svd(cross + HOLD * np.linalg.norm(cross) / width * self.rotation.T)
            self.rotation = (u @ vt).T
        n = data.count()
        self.coarse = _summed(data, lambda c: _stacked(c, width).sum(0)[None], 1, width)[0] @ self.rotation.T / n
        books = self._books(start @ self.rotation.T - self.coarse)
        for _ in range(self.rounds):
            new = self._moved(data, books, self.coarse)
            if np.allclose(new, books, atol=1e-9):
                break
            books = new
        self.books = books
        discarded(table)
        return self

    def _books(self, rows: np.ndarray) -> np.ndarray:
        return np.swapaxes(rows.reshape(len(rows), self.parts, -1), 0, 1).copy()

    def _moved(self, data: DataFrame, books: np.ndarray, coarse: np.ndarray) -> np.ndarray:
        """The means of what is nearest to each centroid."""
        (parts, size, part), rotation = books.shape, self.rotation
        width = parts * part

        def sums(column):
            x = (_stacked(column, width) @ rotation.T - coarse).reshape(-1, parts, part)
            codes = _nearest(x, books)
            out = np.zeros((parts, size, part + 1))
            for p in range(parts):
                np.add.at(out[p], codes[:, p], np.concatenate([x[:, p], np.ones((len(x), 1))], axis=1))
            return out.reshape(parts * size, part + 1)

        total = _summed(data, sums, parts * size, part + 1).reshape(parts, size, part + 1)
        n = total[:, :, -1:]
        return np.where(n > 0, total[:, :, :-1] / np.maximum(n, 1), books)

    def _cross(self, data: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
        """The sum of x y^T over vectors x and their centroids y."""
        (parts, _, part), rotation = books.shape, self.rotation

        def sums(column):
            x = _stacked(column, width)
            codes = _nearest((x @ rotation.T).reshape(-1, parts, part), books)
            return x.T @ np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)

        return _summed(data, sums, width, width)

    def encode(self, vectors: DataFrame, vec: str = "vec") -> DataFrame:
        """vectors with codes, and error (squared distance from what the codes stand for), in place of the vector column."""
        books, rotation, coarse = self.books, self.rotation, self.coarse
        parts, _, part = books.shape
        width = parts * part
        names = [c for c in vectors.columns if c != vec]
        schema = ", ".join([f"`{c}` {dict(vectors.dtypes)[c]}" for c in names] + ["codes array<int>", "error double"])

        def run(batches):
            for batch in batches:
                column = batch.column(batch.schema.get_field_index("_rotated"))
                x = (_stacked(column.drop_null(), width) @ rotation.T - coarse).reshape(-1, parts, part)
                codes = _nearest(x, books)
                error = sum(((x[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(parts))
                at = np.full(batch.num_rows, -1)
                at[column.is_valid().to_numpy(zero_copy_only=False)] = np.arange(len(x))
                index = pa.array(at, pa.int64(), mask=at < 0)
                lists = pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32())).take(index)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), lists, pa.array(error, pa.float64()).take(index)], names=[*names, "codes", "error"])

        return vectors.select(*names, F.slice(F.col(vec).cast("array<double>"), 1, width).alias("_rotated")).mapInArrow(run, schema)


def principal_components(vectors: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the k directions of largest variance (rows), and their variances (over n - 1). The sign of a direction makes its entry of
    largest size positive (the first of equal ones), so that runs agree. Null vectors take no part."""
    data = kept(vectors.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")), "whiten")
    n, width = data.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if n < 2:
        raise ValueError("whitening needs two vectors at least")
    mean = _summed(data, lambda c: _stacked(c, width).sum(0)[None], 1, width)[0] / n

    def moments(column):
        x = _stacked(column, width) - mean  # centred first, so that large means cost no digits
        return x.T @ x

    values, axes = np.linalg.eigh(_summed(data, moments, width, width) / (n - 1))
    discarded(data)
    order = np.argsort(-values, kind="stable")[:k]
    rows = axes[:, order].T
    largest = np.argmax(np.round(np.abs(rows), 9), axis=1)
    rows = rows * np.sign(rows[np.arange(len(rows)), largest])[:, None]
    return mean, rows, values[order]


def whiten(vectors: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Principal components scaled to unit variance, as vec; a component without variance is 0. Null vectors stay null."""
    mean, rows, values = principal_components(vectors, k, vec)
    scale = np.where(values > 1e-12 * max(values[0], 1e-300), 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    turn = (rows * scale[:, None]).T

    @F.pandas_udf("array<double>")
    def turned(s):
        import pandas as pd

        held = s.notna().to_numpy()
        rows = iter((np.stack(s[held].to_numpy()) - mean) @ turn) if held.any() else iter(())
        return pd.Series([next(rows) if h else None for h in held], dtype=object)

    return vectors.withColumn(vec, turned(F.col(vec).cast("array<double>")))
