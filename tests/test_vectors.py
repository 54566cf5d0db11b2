"""Quantisers, whitening and slot pairing against NumPy and enumeration."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import item_codes as K
from strandline.operators import rotation as R

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def vectors(spark, x, parts=3):
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(parts)


def correlated(n=400, width=8, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 3)) @ rng.normal(size=(3, width)) * 3
    return base + rng.normal(size=(n, width)) * 0.2 + 5


def start_of(spark, x, size, seed, some=None):
    """The rows from which training starts: those of least hash."""
    keys = spark.createDataFrame([(k,) for k in range(len(x)) if some is None or some[k]], "id long").select("id", F.xxhash64(F.lit(seed), "id").alias("h")).collect()
    return x[[r["id"] for r in sorted(keys, key=lambda r: r["h"])[:size]]]


def nearest(x, books):
    return np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(2).argmin(1) for p in range(len(books))], 1)


def means(x, books):
    codes, out = nearest(x, books), books.copy()
    for p in range(len(books)):
        for c in range(books.shape[1]):
            if (codes[:, p] == c).any():
                out[p, c] = x[codes[:, p] == c, p].mean(0)
    return out


def plain_rotated(x, start, parts, turns, rounds):
    split = lambda v: v.reshape(len(v), parts, -1)
    rotation, books, errors = np.eye(x.shape[1]), np.swapaxes(split(start), 0, 1).copy(), []
    for _ in range(turns):
        turned = split(x @ rotation.T)
        books = means(turned, books)
        codes = nearest(turned, books)
        y = np.concatenate([books[p][codes[:, p]] for p in range(parts)], 1)
        errors.append(((x @ rotation.T - y) ** 2).sum())
        cross = x.T @ y
        u, _, vt = np.linalg.svd(cross + 1e-6 * np.linalg.norm(cross) / len(cross) * rotation.T)
        rotation = (u @ vt).T
        errors.append(((x @ rotation.T - y) ** 2).sum())
    coarse = (x @ rotation.T).mean(0)
    rest = split(x @ rotation.T - coarse)
    books = np.swapaxes(split(start @ rotation.T - coarse), 0, 1).copy()
    for _ in range(rounds):
        books = means(rest, books)
    return rotation, coarse, books, errors


@pytest.mark.parametrize("masked", [False, True])
def test_rotated_codes_equal_numpy(spark, masked):
    x = correlated()
    some = np.arange(len(x)) % 3 != 0 if masked else np.ones(len(x), bool)
    q = R.RotatedQuantizer(2, 6, 4, 4, seed=5).fit(vectors(spark, x), train=F.col("id") % 3 != 0 if masked else None)
    rotation, coarse, books, errors = plain_rotated(x[some], start_of(spark, x, 6, 5, some), 2, 4, 4)
    np.testing.assert_allclose(q.rotation, rotation, atol=1e-8)
    np.testing.assert_allclose(q.coarse, coarse, atol=1e-8)
    np.testing.assert_allclose(q.books, books, atol=1e-8)
    assert all(b <= a * (1 + 1e-6) for a, b in zip(errors, errors[1:], strict=False))  # no step makes it worse
    np.testing.assert_allclose(rotation @ rotation.T, np.eye(8), atol=1e-9)
    rest = (x @ rotation.T - coarse).reshape(len(x), 2, -1)
    codes = nearest(rest, books)
    error = sum(((rest[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(2))
    rows = {r["id"]: r for r in q.encode(vectors(spark, x, 5)).collect()}
    assert len(rows) == len(x)
    for k in range(len(x)):
        assert rows[k]["codes"] == codes[k].tolist() and rows[k]["error"] == pytest.approx(error[k])


def test_a_rotation_lessens_the_distortion(spark):
    x = correlated(seed=3)
    plain = K.ProductQuantizer(2, 8, 12).fit(vectors(spark, x))
    books = plain.books
    split = x.reshape(len(x), 2, -1)
    codes = nearest(split, books)
    without = np.mean(sum(((split[:, p] - books[p][codes[:, p]]) ** 2).sum(1) for p in range(2)))
    table = vectors(spark, x)
    turned = R.RotatedQuantizer(2, 8, 12, 12).fit(table).encode(table).agg(F.avg("error")).first()[0]
    assert turned < 0.9 * without


def test_null_vectors_and_repeated_rows(spark):
    x = correlated(30)
    df = vectors(spark, x).unionByName(spark.createDataFrame([(100, None), (101, None)], "id long, vec array<double>"))
    rows = R.RotatedQuantizer(2, 4, 2, 2).fit(df).encode(df).collect()
    assert len(rows) == 32 and all((r["codes"] is None and r["error"] is None) == (r["id"] >= 100) for r in rows)
    white = {r["id"]: r["vec"] for r in R.whiten(df, 2).collect()}
    assert white[100] is None and len(white[0]) == 2
    with pytest.raises(ValueError, match="no vectors"):
        R.RotatedQuantizer().fit(df.limit(0))


def whitened(x, k):
    values, axes = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)[:k]
    rows = axes[:, order].T
    rows = rows * np.sign(rows[np.arange(k), np.abs(rows).argmax(1)])[:, None]
    return (x - x.mean(0)) @ (rows / np.sqrt(values[order])[:, None]).T


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_numpy_on_any_partitions(spark, parts):
    x = correlated(seed=2) + 1000
    got = {r["id"]: r["vec"] for r in R.whiten(vectors(spark, x, parts), 4).collect()}
    want = whitened(x, 4)
    np.testing.assert_allclose([got[k] for k in range(len(x))], want, atol=1e-6)
    np.testing.assert_allclose(np.cov(want.T), np.eye(4), atol=1e-9)


@tables
def test_vector_queries_equal_numpy(spark):
    from strandline.plans import extraction

    rows = sorted(extraction._vectors(spark, SF).select("id", "vec").collect(), key=lambda r: r["id"])
    ids, x = [r["id"] for r in rows], np.array([r["vec"] for r in rows], float)
    got = {r["id"]: r["vec"] for r in extraction.whitened_vectors(spark, SF).collect()}
    np.testing.assert_allclose([got[k] for k in ids], whitened(x, 8), atol=2e-6)
    by_hash = spark.createDataFrame([(k,) for k in ids], "id long").select("id", F.xxhash64(F.lit(2024), "id").alias("h")).collect()
    at = {k: i for i, k in enumerate(ids)}
    order = [at[r["id"]] for r in sorted(by_hash, key=lambda r: r["h"])]
    # product quantisation
    width = x.shape[1] // 4 * 4
    split = x[:, :width].reshape(len(x), 4, -1)
    books = np.swapaxes(split[order[:16]], 0, 1).copy()
    for _ in range(5):
        books = means(split, books)
    codes = nearest(split, books)
    got = {r["id"]: r["codes"] for r in extraction.product_codes(spark, SF).collect()}
    assert got == {k: " ".join(map(str, codes[i])) for i, k in enumerate(ids)}
    # with a rotation, trained on what was bought
    bought = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey").distinct().collect()}
    some = [i for i in order if ids[i] in bought]
    rotation, coarse, books, _ = plain_rotated(x[sorted(some), :width], x[some[:16], :width], 4, 5, 5)
    codes = nearest((x[:, :width] @ rotation.T - coarse).reshape(len(x), 4, -1), books)
    got = {r["id"]: r["codes"] for r in extraction.rotated_codes(spark, SF).collect()}
    assert got == {k: " ".join(map(str, codes[i])) for i, k in enumerate(ids)}


@pytest.mark.parametrize("slots", [2, 4, 6, 8])
@pytest.mark.parametrize("seed", range(3))
def test_slot_pairing_equals_enumeration(spark, slots, seed):
    rng = np.random.default_rng(seed)
    edges = [(a, b, int(rng.integers(0, 4))) for a in range(slots) for b in range(a + 1, slots) if rng.random() < 0.9]
    score = {(a, b): n for a, b, n in edges}
    ways = [w for w in K.perfect_matchings(slots) if all(p in score for p in w)]
    got = K.best_matching(spark.createDataFrame(edges, "a int, b int, max_freq long"), slots).collect()
    if not ways:
        assert got == []
        return
    best = max(ways, key=lambda w: (sum(score[p] for p in w), [(-a, -b) for a, b in w]))
    assert got[0]["total"] == sum(score[p] for p in best) and [(r["a"], r["b"], r["score"]) for r in got[0]["pairs"]] == [(*p, score[p]) for p in best]


def test_sixteen_slots_are_paired_at_once(spark):
    edges = spark.createDataFrame([(a, b, (a * 7 + b * 13) % 11) for a in range(16) for b in range(a + 1, 16)], "a int, b int, max_freq long").cache()
    edges.count()
    began = time.process_time()
    assert len(K.best_matching(edges, 16).collect()[0]["pairs"]) == 8
    assert time.process_time() - began < 1
