"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are taken where it is read and transformed to be roughly normal. Class
means and covariances come from sums and cross products over all labelled rows outside the held-out
fold (no sample), added up by a distributed aggregation, so the driver receives two small matrices.
Covariances are shrunk towards the pooled one and towards a multiple of the identity; their Cholesky
factors are computed once, and a score is the logistic of the difference of the two Mahalanobis log
densities plus the log prior odds.

Defined results for odd input: a null text is an empty one, and is scored like any other; a null
doc_id is never a training row; documents with the same doc_id are scored each on their own text; a
doc_id with several labels counts with the largest; labels other than 0 and 1 are ignored; without
both labels every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import operator
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

FEATURES = (
    "log_words", "log_chars", "word_length", "lower", "upper", "digit", "symbol", "pipe", "bang", "stop",
    "other_ascii", "non_ascii", "log_lines", "distinct", "adjacent", "packed",
)
FOLDS = 5
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    table = np.full(256, 9, np.uint8)  # other ASCII
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>", b"|", b"!", b".,;:?")):
        table[list(chars)] = k
    table[128:] = 7
    table[[9, 10, 11, 12, 13, 32]] = 8
    return table


_TABLE = _classes()


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    c = np.bincount(_TABLE[np.frombuffer(raw, np.uint8)], minlength=10) if raw else np.zeros(10)
    solid = max(1, len(raw) - int(c[8]))
    share = np.sqrt(c / solid)
    distinct = len(set(words)) / n if n else 1.0
    adjacent = sum(map(operator.eq, words, words[1:])) / n if n else 0.0
    packed = len(zlib.compress(raw, 1)) / len(raw) if raw else 1.0
    return [
        np.log1p(n), np.log1p(len(raw)), np.log1p(solid / max(1, n)), share[0], share[1], share[2], share[3], share[4], share[5],
        share[6], share[9], share[7], np.log1p(raw.count(b"\n")) - 0.5 * np.log1p(n), distinct, np.sqrt(adjacent), min(packed, 2.0),
    ]


def _featurise(batches):
    for batch in batches:
        rows = [statistics(t) for t in batch.column(1).to_pylist()]
        flat = pa.array(np.asarray(rows, np.float64).ravel())
        f = pa.FixedSizeListArray.from_arrays(flat, len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), f], names=["doc_id", "f"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and f, the statistics of the text."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_featurise, "doc_id long, f array<double>")


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(batches):
    """Sums and cross products of each class over a task, one row per entry."""
    d = len(FEATURES) + 1
    sums = np.zeros((2, d, d))
    for batch in batches:
        x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column("f"), d - 1)]) if batch.num_rows else np.zeros((0, d))
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            sums[k] += x[y == k].T @ x[y == k]
    flat = sums.ravel()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["k", "v"])


class QDA:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, moments: np.ndarray, to_pooled: float = 0.5, to_identity: float = 0.01, temperature: float = 2.0):
        self.parts = None
        n = moments[:, 0, 0]
        d = moments.shape[1] - 1
        if n.min() < 2:
            return
        means = moments[:, 0, 1:] / n[:, None]
        covs = np.array([moments[k][1:, 1:] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)])
        pooled = (n[:, None, None] * covs).sum(0) / n.sum()
        # every statistic is measured in pooled standard deviations, so that shrinking treats them alike
        self.scale = 1 / np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        s = np.outer(self.scale, self.scale)
        self.parts, self.temperature = [], temperature
        for k in (0, 1):
            c = ((1 - to_pooled) * covs[k] + to_pooled * pooled) * s
            c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-6) * np.eye(d)
            chol = np.linalg.cholesky(c)
            inverse = np.linalg.solve(chol, np.eye(d))
            self.parts.append((means[k], inverse, -np.log(np.diag(chol)).sum()))
        self.log_odds = float(np.log(n[1] / n[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), 0.5)
        density = [c - 0.5 * ((((x - m) * self.scale) @ inv.T) ** 2).sum(1) for m, inv, c in self.parts]
        z = (density[1] - density[0]) / self.temperature + self.log_odds
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, **options) -> QDA:
    """Fit on all labelled rows outside the held-out fold."""
    truth = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    rows = feats.where(F.col("doc_id").isNotNull() & ~held_out()).join(truth, "doc_id").select("f", "quality")
    d = len(FEATURES) + 1
    sums = np.zeros(2 * d * d)
    for r in rows.mapInArrow(_moments, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():  # 2 d^2 numbers
        sums[r["k"]] = r["v"]
    return QDA(sums.reshape(2, d, d), **options)


def _scorer(model: QDA):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(_matrix(batch.column("f"), len(FEATURES)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    feats = stored(features(docs), "statistics")
    model = fit(feats, labels, **options)
    scored = feats.mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


ORACLE_SQL = None
