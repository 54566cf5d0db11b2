"""Item code tuples: quantisation, collision digits, slot statistics and slot pairing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_collision_digit(items: DataFrame, item: str = "item", codes: str = "codes", buckets: int = 128, seed: int = 2024, more: str = "raise") -> DataFrame:
    """items with feats: the codes and a last digit that tells items of the same codes apart.

    The n-th item (by id) of a tuple takes the n-th entry of a permutation of the buckets that belongs
    to the tuple: x -> (a x + b) mod buckets with a odd and both from a hash of the tuple, which is a
    permutation where buckets is a power of two. Where a tuple has more items than buckets, more says what is done: ``raise``;
    ``repeat``, the permutation starts again, so that digits come up more than once; or ``digits``, the rounds through it stand
    before the last digit in digits of their own, so that no two items are alike."""
    if buckets & (buckets - 1):
        raise ValueError("the number of buckets must be a power of two")
    if more not in ("raise", "repeat", "digits") or (more == "digits" and buckets < 2):
        raise ValueError("more is raise, repeat or, for two buckets at least, digits")
    # the window counts as it reads the sorted rows of a tuple and holds none of them
    n = F.row_number().over(Window.partitionBy(codes).orderBy(item)) - 1
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(codes).cast("array<string>"))), 1, 14), 16, 10).cast("long")
    a = F.pmod(h, F.lit(buckets)).bitwiseOR(F.lit(1))
    b = F.pmod(F.shiftright(h, 20), F.lit(buckets))
    digit = F.pmod(a * n + b, F.lit(buckets))
    if more == "raise":
        digit = F.when(n >= buckets, F.raise_error(F.lit("more items of one code tuple than hash buckets")).cast("long")).otherwise(digit)
    before = []
    if more == "digits":
        bits = buckets.bit_length() - 1
        rounds = [F.shiftright(n, k * bits) for k in range(31 // bits, 0, -1)]  # row numbers have 31 bits
        before = [F.array_compact(F.array(*[F.when(r > 0, F.pmod(r, F.lit(buckets)).cast("long")) for r in rounds]))]
    return items.withColumn("feats", F.concat(F.col(codes).cast("array<bigint>"), *before, F.array(digit)))


def collision_stats(items: DataFrame, codes: str = "codes") -> DataFrame:
    """Distinct tuples, tuples used more than once, items in those, and the largest group."""
    groups = items.groupBy(codes).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_tuples"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_affected"),
        F.max("n").alias("largest"),
    )


def repeated_tuples(items: DataFrame, codes: str = "feats") -> DataFrame:
    """Tuples that more than one item has; empty if the tuples identify items."""
    return items.groupBy(codes).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_codes(text: DataFrame, image: DataFrame, item: str = "item") -> DataFrame:
    """Text codes followed by image codes; items that lack either are left out."""
    both = text.select(item, F.col("codes").alias("_t")).join(image.select(item, F.col("codes").alias("_i")), item)
    return both.select(item, F.concat("_t", "_i").alias("codes"))


def slot_pair_frequency(uses: DataFrame, slots: int, codes: str = "codes", weight: str = "n") -> DataFrame:
    """For every slot pair the total of the most frequent value pair, and how many value pairs there are.

    uses: one row per item with its codes and how often it is used."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.get(codes, F.lit(a)).alias("va"), F.get(codes, F.lit(b)).alias("vb")) for a, b in combinations(range(slots), 2)])
    flat = uses.select(weight, F.inline(pairs))
    return flat.groupBy("a", "b", "va", "vb").agg(F.sum(weight).alias("n")).groupBy("a", "b").agg(F.max("n").alias("max_freq"), F.count(F.lit(1)).alias("n_pairs"))


def perfect_matchings(slots: int) -> list[list[tuple[int, int]]]:
    """All ways to pair up an even number of slots, in lexicographic order."""
    if slots % 2:
        raise ValueError("an even number of slots is needed")

    def go(left: tuple[int, ...]):
        if not left:
            yield []
            return
        for k in range(1, len(left)):
            for rest in go(left[1:k] + left[k + 1 :]):
                yield [(left[0], left[k]), *rest]

    return list(go(tuple(range(slots))))


def best_matching(edges: DataFrame, slots: int, score: str = "max_freq") -> DataFrame:
    """The pairing of slots with the largest total score; of equal ones the lexicographically first.

    edges: (a, b, score), one row for a pair of slots at most, which is all that the driver gets. The best pairing of a set of
    slots is that of its first slot with some other and the best pairing of the rest, kept for every set that comes up: for
    16 slots these are some ten thousand, where the pairings are two million."""
    if slots % 2:
        raise ValueError("an even number of slots is needed")
    score_of = {(r["a"], r["b"]): r["score"] for r in edges.select("a", "b", F.col(score).alias("score")).where(F.col("a") < F.col("b")).limit(slots * slots).collect()}
    held: dict[int, tuple | None] = {0: (0, ())}

    def best(left: int):
        if left not in held:
            first = (left & -left).bit_length() - 1
            found = None
            for other in range(first + 1, slots):
                if left >> other & 1 and (first, other) in score_of:
                    rest = best(left & ~(1 << first | 1 << other))
                    # the smallest partner of the first slot comes first, so of equal totals it stays
                    if rest is not None and (found is None or score_of[first, other] + rest[0] > found[0]):
                        found = score_of[first, other] + rest[0], ((first, other), *rest[1])
            held[left] = found
        return held[left]

    found = best((1 << slots) - 1)
    kind = dict(edges.dtypes)[score]
    rows = [] if found is None or not slots else [(found[0], [(a, b, score_of[a, b]) for a, b in found[1]])]
    total = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind
    return edges.sparkSession.createDataFrame(rows, f"total {total}, pairs array<struct<a:int,b:int,score:{kind}>>")


class ProductQuantizer:
    """Codebooks of each sub-vector by k-means, and codes by nearest centroid.

    Training runs Lloyd's rounds as aggregations: each round assigns every vector in Arrow batches and
    sums by (part, centroid) before the shuffle, so the driver only sees the centroids."""

    def __init__(self, parts: int = 4, size: int = 256, rounds: int = 10, seed: int = 2024):
        self.parts, self.size, self.rounds, self.seed = parts, size, rounds, seed
        self.books: np.ndarray | None = None  # parts x size x width

    def fit(self, vectors: DataFrame, vec: str = "vec", key: str = "id") -> ProductQuantizer:
        width = len(vectors.select(vec).first()[0]) // self.parts
        # the start: distinct vectors of least seeded hash, at most ``size`` rows
        start = vectors.orderBy(F.xxhash64(F.lit(self.seed), key)).limit(self.size).select(vec).collect()
        first = np.array([r[0][: width * self.parts] for r in start], float).reshape(len(start), self.parts, width)
        books = np.swapaxes(first, 0, 1).copy()
        for _ in range(self.rounds):
            sums = np.zeros_like(books)
            counts = np.zeros(books.shape[:2])
            for r in self._sums(vectors.select(vec), books).collect():
                sums[r["part"], r["code"]], counts[r["part"], r["code"]] = r["total"], r["n"]
            new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], books)
            if np.allclose(new, books, atol=1e-9):
                break
            books = new
        self.books = books
        return self

    def _sums(self, vectors: DataFrame, books: np.ndarray) -> DataFrame:
        parts, size, width = books.shape

        def run(batches):
            total, n = np.zeros_like(books), np.zeros((parts, size))
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf.iloc[:, 0].to_numpy())[:, : parts * width].reshape(-1, parts, width)
                    codes = _nearest(x, books)
                    for p in range(parts):
                        np.add.at(total[p], codes[:, p], x[:, p])
                        np.add.at(n[p], codes[:, p], 1)
            rows = [(p, c, n[p, c], total[p, c].tolist()) for p in range(parts) for c in range(size) if n[p, c]]
            yield pd.DataFrame(rows, columns=["part", "code", "n", "total"])

        flat = vectors.mapInPandas(run, "part int, code int, n double, total array<double>")
        at = flat.select("part", "code", "n", F.posexplode("total").alias("k", "x"))
        one = at.groupBy("part", "code", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        return one.groupBy("part", "code").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("total"))

    def encode(self, vectors: DataFrame, vec: str = "vec") -> DataFrame:
        """vectors with codes in place of the vector column."""
        books = self.books
        parts, _, width = books.shape

        @F.pandas_udf("array<int>")
        def assign(s: pd.Series) -> pd.Series:
            if not len(s):
                return pd.Series([], dtype=object)
            x = np.stack(s.to_numpy())[:, : parts * width].reshape(-1, parts, width)
            return pd.Series(list(_nearest(x, books).astype(np.int32)))

        return vectors.withColumn("codes", assign(F.col(vec).cast("array<double>"))).drop(vec)


def _nearest(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Codes (rows x parts) of the nearest centroids, the first on ties."""
    out = np.empty(x.shape[:2], np.int64)
    for p in range(books.shape[0]):
        d = (x[:, p] ** 2).sum(1)[:, None] - 2 * x[:, p] @ books[p].T + (books[p] ** 2).sum(1)[None]
        out[:, p] = d.argmin(1)
    return out
