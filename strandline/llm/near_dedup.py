"""Near-duplicate detection with ProbMinHash signatures.

A document is a probability distribution over its five-word shingles (weights: how often each occurs).
Each shingle draws the arrivals of a Poisson process whose rate is its weight; an arrival hits a random
register, and a register remembers the shingle that arrived first. Arrivals past the time at which all
registers are surely hit are never drawn (early termination; the limit is doubled for a document that
still has an empty register). Two registers agree with the probability Jaccard similarity of the two
documents. Bands of registers make buckets; candidate pairs are verified exactly on the words.

Equal texts are collapsed first. Of the documents that share a bucket, those are set apart of whose shingle
mass more than a fifth is found in no other of them: the similarity of two distributions is at most the
mass that they share, so such a document has no near duplicate. Buckets are never turned into all their
pairs: in two rounds every document of a bucket meets one member of another class, first the one with the
most shared mass and then a random one, and verified links merge classes, so a bucket of thousands of near
copies costs a few comparisons for each of them. The documents of buckets that still hold several classes
then go through an exact prefix filter: with shingles ordered from rare to frequent, two documents that
share 0.8 of their mass have a shingle in common among those that make up the first 0.2 of each. Pairs of
different classes with such a shingle are verified one by one, so no candidate of a bucket is lost. Classes
are connected components, found by distributed hooking and pointer jumping.

Defined results for odd input: a null text is an empty one; texts without words have no shingles and only
equal ones meet; a text of fewer than five words is one shingle; rows that repeat are copies of each
other; a null doc_id is carried as it is and never names a class that has another id; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, keep_rows, read, stored
from .shingles import SHINGLE_WORDS, mix, shingles

BANDS, ROWS = 36, 7
THRESHOLD = 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(texts: list[bytes], registers: int = BANDS * ROWS) -> np.ndarray:
    """One row of winning shingle hashes for each text; 0 throughout for a text without words."""
    doc, sh = shingles(texts)
    n = len(texts)
    win = np.zeros((n, registers), np.uint64)
    if not len(doc):
        return win
    # distinct shingles of each document and their weights
    _, at, weight = np.unique(sh ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    doc, sh, weight = doc[at], sh[at], weight.astype(np.float64)
    mass = np.bincount(doc, weight, minlength=n)
    limit = np.where(mass > 0, registers * (math.log(registers) + 2.0) / np.maximum(mass, 1.0), 0.0)
    flat, best = win.reshape(-1), np.full(n * registers, np.inf)
    d, s, w, k = doc, sh, weight, 0
    t = np.zeros(len(d))
    waiting: list[tuple] = []  # processes whose next arrival lies past the limit, in case it is raised
    while True:
        while len(d):
            k += 1
            x = mix(s + np.uint64((int(_STEP) * k) & (2**64 - 1)))
            t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
            late = t > limit[d]
            if late.any():
                waiting.append((d[late], s[late], w[late], t[late], np.full(int(late.sum()), k)))
                on = ~late
                d, s, w, t, x = d[on], s[on], w[on], t[on], x[on]
            _hit(flat, best, d, s, t, x, registers)
        short = np.isinf(best.reshape(n, registers)).any(axis=1) & (mass > 0)
        if not short.any():
            return win
        # raise the limit of those documents and go on with their waiting arrivals, one count at a time
        limit[short] *= 2
        again, waiting2 = [], []
        for wd, ws, ww, wt, wk in waiting:
            go = short[wd]
            again.append((wd[go], ws[go], ww[go], wt[go], wk[go]))
        d, s, w, t, ks = (np.concatenate(c) for c in zip(*again, strict=True))
        while len(d):
            early = t <= limit[d]
            waiting2.append((d[~early], s[~early], w[~early], t[~early], ks[~early]))
            d, s, w, t, ks = d[early], s[early], w[early], t[early], ks[early]
            _hit(flat, best, d, s, t, mix(s + _STEP * ks.astype(np.uint64)), registers)
            ks = ks + 1
            x = mix(s + _STEP * ks.astype(np.uint64))
            t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        waiting = waiting2


def _hit(flat, best, d, s, t, x, registers: int) -> None:
    """Enter arrivals: a register keeps its earliest."""
    at = d * registers + (mix(x ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
    np.minimum.at(best, at, t)
    first = best[at] == t
    flat[at[first]] = s[first]


def band_hashes(win: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    part = win.reshape(len(win), bands, rows)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, part.shape[:2]).copy()
    for k in range(rows):
        h = mix(h ^ part[:, :, k]) + np.uint64(k)
    return h


def probability_jaccard(x: Counter, y: Counter) -> float:
    """Sum over common elements d of 1 / sum over e of max(x[e] / x[d], y[e] / y[d])."""
    common = x.keys() & y.keys()
    if not common:
        return 0.0
    sx, sy = sum(x.values()), sum(y.values())
    if sx == len(x) and sy == len(y):
        return len(common) / (sx + sy - len(common))
    # with r = y / x, the maximum is x[e] / x[d] where r[e] <= r[d], and y[e] / y[d] elsewhere
    every = sorted((y[e] / x[e] if e in x else math.inf, x[e], y[e]) for e in x.keys() | y.keys())
    ratio = np.array([e[0] for e in every])
    cx = np.concatenate([[0.0], np.cumsum([e[1] for e in every])])
    cy = np.concatenate([[0.0], np.cumsum([e[2] for e in every])])
    total = 0.0
    for e in common:
        k = int(np.searchsorted(ratio, y[e] / x[e], side="right"))
        total += 1.0 / (cx[k] / x[e] + (cy[-1] - cy[k]) / y[e])
    return total


def word_shingles(text: bytes) -> Counter:
    w = text.split()
    if not w:
        return Counter()
    return Counter(zip(*(w[k:] for k in range(SHINGLE_WORDS)), strict=False)) if len(w) >= SHINGLE_WORDS else Counter([tuple(w)])


def _chunks(texts: list[bytes], most_bytes: int = 1_000_000, most_docs: int = 256):
    a = size = 0
    for k, t in enumerate(texts):
        if k > a and (size + len(t) > most_bytes or k - a >= most_docs):
            yield a, k
            a, size = k, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _sign(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()]
        for a, b in _chunks(texts):
            win = signatures(texts[a:b])
            keys = band_hashes(win)
            has = win[:, 0] != 0
            bands = [k.astype(np.int64) if ok else None for k, ok in zip(keys.view(np.int64), has, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array([hashlib.sha256(t).digest()[:16] for t in texts[a:b]], pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array([press.compress(t) for t in texts[a:b]], pa.binary()),
                ],
                names=["row", "doc_id", "digest", "bands", "z"],
            )


def _verifier(threshold: float):
    def run(batches):
        import zstandard

        plain = zstandard.ZstdDecompressor()
        seen: dict = {}  # shingles of the last few documents; runs of pairs share one

        def of(row, z):
            if row not in seen:
                if len(seen) >= 64:
                    seen.pop(next(iter(seen)))
                seen[row] = word_shingles(plain.decompress(z) if len(z) else b"")
            return seen[row]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            za, zb = batch.column("za"), batch.column("zb")
            ok = []
            for k in range(batch.num_rows):
                x, y = of(a[k], za[k].as_py()), of(b[k], zb[k].as_py())
                small, large = sorted((sum(x.values()), sum(y.values())))
                ok.append(probability_jaccard(x, y) >= threshold if large else True)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) with linked; each side's compressed text is fetched by a shuffled join."""
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("z").alias("za")), "a")
    both = both.join(texts.select(F.col("row").alias("b"), F.col("z").alias("zb")), "b")
    return both.select("a", "b", "za", "zb").mapInArrow(_verifier(threshold), "a long, b long, linked boolean")


def merge_classes(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (row, cls) after joining the classes that links (a, b) connect; a class is its least row."""
    while True:
        edges = links.join(labels.select(F.col("row").alias("a"), F.col("cls").alias("u")), "a")
        edges = edges.join(labels.select(F.col("row").alias("b"), F.col("cls").alias("v")), "b").where("u != v")
        up = edges.select(F.greatest("u", "v").alias("cls"), F.least("u", "v").alias("up")).groupBy("cls").agg(F.min("up").alias("up"))
        up = stored(up, "hooks")
        if up.isEmpty():
            discard(labels.sparkSession, up)
            return labels
        while True:  # every class hooks to a smaller one; halve the paths until all point at a root
            far = up.select(F.col("cls").alias("up"), F.col("up").alias("far"))
            jumped = stored(up.join(far, "up", "left").select("cls", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            old, up = up, jumped
            discard(labels.sparkSession, old)
            if not moved:
                break
        new = stored(labels.join(up.select("cls", "up"), "cls", "left").select("row", F.coalesce("up", "cls").alias("cls")), "classes")
        discard(labels.sparkSession, up, labels)
        labels = new


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (true for one row of each class), digest.

    class_id is the least doc_id of the class.
    """
    spark = docs.sparkSession
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(slim.mapInArrow(_sign, "row long, doc_id long, digest binary, bands array<long>, z binary"), "signed")
    groups = signed.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups, "texts")
    reps = signed.join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    member = reps.select("row", F.explode("bands").alias("band"))
    member = _shared(member)
    texts = stored(signed.select("row", "z").join(member.select("row").distinct(), "row", "left_semi"), "candidates")
    shares = stored(texts.mapInArrow(_shingle_shares, "row long, h long, share float, n int"), "shingles")
    able = _able(shares, threshold)
    old, member = member, _shared(member.join(able, "row"))
    discard(spark, old)
    labels = stored(member.select("row", F.col("row").alias("cls")).distinct(), "classes")
    old, texts = texts, stored(texts.join(labels.select("row"), "row", "left_semi"), "candidates")
    discard(spark, old)
    tested = None
    for turn in (1, 2, 3, 4):
        now = member.join(labels, "row")
        draw = F.xxhash64("row", F.pmod("band", F.lit(4)), F.lit(turn))  # a few different members over the bands
        by = F.struct(F.col("held"), F.col("n"), F.col("row")) if turn == 1 else F.struct(draw, F.col("row"))
        here = F.struct(by.alias("by"), "cls", "row", "n", "c")
        ends = now.groupBy("band").agg(F.max(here).alias("x"), F.min(here).alias("y"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low != high")
        ends = stored(ends, "ends")
        if turn < 4:
            met = now.join(ends.select("band", F.array("x", "y").alias("other")), "band").select("row", "cls", "n", "c", F.explode("other").alias("o"))
            pairs = met.where("cls != o.cls").select("row", "n", "c", F.col("o.row").alias("row2"), F.col("o.n").alias("n2"), F.col("o.c").alias("c2"))
            pairs = pairs.where(_possible(threshold))
        else:
            left = stored(now.join(ends.select("band"), "band").select("row", "cls", "n", "c").distinct(), "unresolved")
            pairs = _prefix_pairs(shares, left, threshold)
        pairs = pairs.select(F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b")).distinct()
        found = _round(pairs, tested, texts, threshold, turn)
        discard(spark, ends)
        labels = merge_classes(labels, found.where("linked").select("a", "b"))
        tested = found if tested is None else tested.unionByName(found)
    return _result(signed, groups, labels)


def _shared(member: DataFrame) -> DataFrame:
    """The rows of member whose band another row has too.

    The bands are written before they meet the rows: a join in one plan with its own grouping takes over the exchange of that, and
    then adaptive execution can't split the rows of a band that many have."""
    shared = stored(member.groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("band"), "shared-bands")
    out = stored(member.join(shared, "band"), "buckets")
    discard(member.sparkSession, shared)
    return out


def _round(pairs: DataFrame, tested: DataFrame | None, texts: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs (a, b) not verified before, with linked."""
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return stored(_verify(pairs, texts, threshold), f"pairs-{turn}")


def _possible(threshold: float):
    """Whether two documents without repeated shingles can be similar, from how many shingles each has (n)
    and how many of those any other has (c); others have n = 0 and are not ruled out here."""
    both = F.least(F.col("c"), F.col("c2"))
    return (F.col("n") == 0) | (F.col("n2") == 0) | (both >= threshold * (F.col("n") + F.col("n2") - both) - 1e-6)


def _able(shares: DataFrame, threshold: float) -> DataFrame:
    """(row, held, n, c) of documents of whose shingle mass at least threshold occurs in another one."""
    known = stored(shares.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"), "known-shingles")
    held = shares.join(known, "h", "left_semi").groupBy("row").agg(F.sum(F.col("share").cast("double")).alias("held"), F.max("n").alias("n"), F.count(F.lit(1)).cast("int").alias("c"))
    able = stored(held.where(F.col("held") >= threshold - 1e-4), "able")
    discard(shares.sparkSession, known)
    return able


def _prefix_pairs(shares: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (row, row2) of different classes that an exact prefix filter leaves.

    The shingles of each row are ordered by how many of the rows have them, rare ones first. Two rows that
    share a mass of threshold have a first common shingle before which neither has more than 1 - threshold of
    its mass. Where no shingle of either is repeated, the similarity is that of sets: they share at least
    t / (1 + t) * (n + n2) shingles, and what comes before the first common one counts against that."""
    t = threshold
    own = stored(shares.select("row", "h", "share").join(rows, "row"), "own-shingles")
    often = stored(own.groupBy("h").agg(F.count(F.lit(1)).alias("k")), "often")
    w = Window.partitionBy("row").orderBy("k", "h")
    before = F.coalesce(F.sum(F.col("share").cast("double")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = own.join(often, "h").withColumn("before", before).withColumn("at", F.row_number().over(w) - 1)
    one = stored(ranked.where((F.col("before") <= 1 - t + 1e-4) & (F.col("k") > 1)).select("row", "cls", "n", "c", "h", "at"), "prefixes")
    discard(shares.sparkSession, own, often)
    two = one.select("h", *[F.col(x).alias(f"{x}2") for x in ("row", "cls", "n", "c", "at")])
    sets = (F.col("n") > 0) & (F.col("n2") > 0)
    room = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) >= t / (1 + t) * (F.col("n") + F.col("n2")) - 1e-6
    return one.join(two, (one.h == two.h) & (F.col("row") < F.col("row2")) & (F.col("cls") != F.col("cls2")) & _possible(t) & (~sets | room))


def _shingle_shares(batches):
    """Compressed texts -> distinct shingles with their share of the text's mass; n is their number where none
    is repeated, else 0."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        texts = [plain.decompress(z) for z in batch.column("z").to_pylist()]
        for a, b in _chunks(texts):
            doc, sh = shingles(texts[a:b])
            key = sh ^ mix(doc.astype(np.uint64) + np.uint64(1))
            _, at, weight = np.unique(key, return_index=True, return_counts=True)
            doc, sh = doc[at], sh[at]
            mass, distinct = np.bincount(doc, weight, minlength=b - a), np.bincount(doc, minlength=b - a)
            n = np.where(mass == distinct, distinct, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[a:b][doc]), pa.array(sh.view(np.int64)), pa.array((weight / mass[doc]).astype(np.float32)), pa.array(n[doc].astype(np.int32))], names=["row", "h", "share", "n"]
            )


def _result(signed: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Classes of texts, then of documents. Sums and minima come from partial aggregations, and the two
    joins back to rows are plain shuffled joins, which adaptive execution splits where a key is hot."""
    full = stored(
        groups.join(labels.withColumnRenamed("row", "rep"), "rep", "left").select("digest", "n", F.coalesce("cls", "rep").alias("cls")), "text-classes"
    )
    rows = stored(signed.select("row", "doc_id", "digest").join(full.select("digest", "cls"), "digest").select("row", "doc_id", "cls", "digest"), "row-classes")
    classes = rows.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(stored(classes, "class-sizes"), "cls").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )


def kept_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, with the columns of docs."""
    return keep_rows(docs, near_classes(docs, threshold).where("kept").select("doc_id", "digest"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents")).drop("digest")


ORACLE_SQL = None
