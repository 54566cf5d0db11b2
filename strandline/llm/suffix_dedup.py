"""Removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

Every string of ``MATCH`` bytes has an anchor: of its GRAM-byte substrings the one with the smallest
hash, leftmost on ties. Equal strings have the same anchor at the same place, so only suffixes that
begin at anchors (about one in eighty bytes) need to be indexed. A suffix enters a suffix array twice, with its
first GRAM bytes as they are: once with the fingerprint of these bytes, which all suffixes that agree so far share, and once with
that of the whole span of bytes that the strings with this anchor cover.

A batch of documents becomes one sorted suffix array: a table of distinct entries with counts (so a
passage that stands everywhere is one row), bucketed, and inside a bucket in the order of the suffixes. It is merge-scanned,
two sorted buckets side by side, against every existing level for suffixes that occur there too, and then levels of
equal size merge, bucket by bucket and without a shuffle, so a suffix is rewritten a logarithmic number of times.
A family at a path outlives the session: later batches meet the levels of earlier ones, and a batch that is added again under its
name is not indexed twice.

Whatever the scans hit is then checked by whole strings: an anchor whose entire span is repeated is
covered; around the ends of matches each single string of MATCH bytes is fingerprinted and looked up.
Fingerprints have 64 bits; no other approximation is made.

Defined results for odd input: a null text is an empty one; texts shorter than MATCH bytes lose
nothing; rows that repeat are separate documents and so match each other whole; a null doc_id is
carried as it is; very long texts are indexed in blocks; bytes of a character may be cut apart, so what
is kept is binary; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, scratch_path, stored, text_or_empty
from .shingles import _BYTES, _DOWN, _UP, mix

MATCH, GRAM = 200, 40
BLOCK = 1 << 20  # string starts of one block of a very long text
BATCHES = 4
#: Contexts of one gram that one task compares: at most 3 MB of bytes and a million strings, less than a second
#: of work. Grams with more contexts take the way by single strings, which has no hot group at all.
HOT = 8_192


class Prints:
    """Fingerprints of substrings of one buffer of at most 2**24 bytes."""

    def __init__(self, data: bytes):
        self.raw = np.frombuffer(data, np.uint8)
        n = len(self.raw)
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[self.raw] * _UP.upto(max(n, 1))[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.total[stop] - self.total[start]) * _DOWN.upto(len(self.total))[start])

    def each(self, size: int) -> np.ndarray:
        """Of every substring of one size."""
        n = len(self.raw) - size + 1
        return mix((self.total[size:] - self.total[:n]) * _DOWN.upto(max(n, 1))[:n])


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours."""
    have, m = 1, v
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def pieces(texts: list[bytes]):
    """(text number, offset, bytes) of every block; blocks overlap by MATCH - 1 bytes."""
    for k, t in enumerate(texts):
        for o in range(0, len(t) - MATCH + 1, BLOCK):
            yield k, o, t[o : o + BLOCK + MATCH - 1]


def anchors(blocks: list[bytes]):
    """Of every anchor: block number, place, first and last start of its strings, place in all blocks together, gram and
    span prints."""
    data = b"".join(blocks)
    sizes = np.array([len(b) for b in blocks])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    prints = Prints(data)
    grams = prints.each(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    best = _window_min((grams & ~np.uint64(0xFFFFFF)) | place, MATCH - GRAM + 1)
    at = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.concatenate([np.arange(a, b - MATCH + 1) for a, b in zip(begins, ends, strict=True)])
    block = np.repeat(np.arange(len(blocks)), sizes - MATCH + 1)
    at = at[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    p, lo, hi, block = at[new], starts[new], starts[last], block[new]
    h1 = grams[p]
    shape = ((p - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    h2 = mix(prints.of(lo, hi + MATCH) + mix(h1 ^ shape))
    return block, p - begins[block], lo - begins[block], hi - begins[block], p, h1.view(np.int64), h2.view(np.int64)


def _parts(batches, rows: int = 512):
    """Small slices of Arrow batches: what a task holds as Python objects stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _groups(items, most: int = 250_000):
    """Runs of blocks that together stay small."""
    run, size = [], 0
    for x in items:
        if run and size + len(x[2]) > most:
            yield run
            run, size = [], 0
        run.append(x)
        size += len(x[2])
    if run:
        yield run


def _bytes(column) -> list[bytes]:
    return [x if isinstance(x, bytes) else (x or "").encode("utf-8", "replace") for x in column.to_pylist()]


def _suffixes(batches):
    """Texts -> the two entries of each anchored suffix: its first GRAM bytes, and a fingerprint."""
    for batch in _parts(batches):
        for run in _groups(pieces(_bytes(batch.column(0)))):
            blocks = [b for _, _, b in run]
            *_, p, h1, h2 = anchors(blocks)
            heads = np.frombuffer(b"".join(blocks), np.uint8)[p[:, None] + np.arange(GRAM)]
            suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(GRAM), len(p), [None, pa.py_buffer(np.ascontiguousarray(heads))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([suffix, suffix]), pa.array(np.concatenate([h1, h2]))], names=["suffix", "h"])


def _places(batches):
    """Documents -> their anchors."""
    for batch in _parts(batches):
        for run in _groups(pieces(_bytes(batch.column(2)))):
            block, _, lo, hi, _, h1, h2 = anchors([b for _, _, b in run])
            row = pa.array(np.array([k for k, _, _ in run], np.int64)[block])
            off = np.array([o for _, o, _ in run], np.int64)[block]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(lo + off), pa.array((hi - lo).astype(np.int32)), pa.array(h1), pa.array(h2)],
                names=["k1", "k2", "lo", "more", "h1", "h2"],
            )


def _contexts(batches):
    """Compressed texts with ranges of starts -> the bytes that the strings of each range cover."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in _parts(batches):
        z, ranges = batch.column("z"), batch.column("ranges")
        out = [[] for _ in range(6)]
        for k in range(batch.num_rows):
            text = plain.decompress(z[k].as_py())
            for r in ranges[k].as_py():
                row = (k, r["h1"], r["hot"], r["lo"], r["more"], text[r["lo"] : r["lo"] + r["more"] + MATCH])
                for col, x in zip(out, row, strict=True):
                    col.append(x)
        one = pa.array(out[0], pa.int64())
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
        cols = [pa.array(c, t) for c, t in zip(out[1:], kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("k1").take(one), batch.column("k2").take(one), *cols], names=["k1", "k2", "h1", "hot", "lo", "more", "bytes"])


def _string_prints(context: list[bytes], more: np.ndarray):
    """(context number, start in it, fingerprint) of every string of every context."""
    sizes = more.astype(np.int64) + MATCH
    begins = np.cumsum(sizes) - sizes
    n = more.astype(np.int64) + 1
    which = np.repeat(np.arange(len(context)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begins[which] + place
    return which, place, Prints(b"".join(context)).of(at, at + MATCH)


def _columns(tables: list[pa.RecordBatch]):
    t = pa.Table.from_batches(tables)
    return {n: t.column(n).to_numpy() if n != "bytes" else t.column(n).to_pylist() for n in t.schema.names}


def _compare(batches):
    """Contexts sorted by gram -> ranges of starts (k1, k2, lo, more) of strings that occur twice in their group.

    Whole groups are compared at once; a group has at most HOT contexts."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(tables):
        c = _columns(tables)
        if not len(c["h1"]):
            return
        which, place, w = _string_prints(c["bytes"], c["more"])
        key = mix(w ^ mix(c["h1"].view(np.uint64)[which]))
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[back] > 1)
        if len(twice):
            d, q = which[twice], place[twice]
            cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (q[1:] != q[:-1] + 1)]))
            stop = np.concatenate([cut[1:], [len(d)]]) - 1
            own = d[cut]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c["k1"][own]), pa.array(c["k2"][own]), pa.array(c["lo"][own] + q[cut]), pa.array((q[stop] - q[cut]).astype(np.int32))], names=["k1", "k2", "lo", "more"]
            )

    for batch in _parts(batches, 1024):
        h = batch.column("h1").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = int(starts[-1])  # the last group may go on in the next batch
        same = held and held[-1].column("h1")[-1].as_py() == h[0]
        if size >= 1024 and (last > 0 or not same):
            yield from flush([*held, batch.slice(0, last)] if same or last else held)
            held, size = [batch.slice(last)], batch.num_rows - last
        else:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield from flush(held)


def _strings(batches):
    """Contexts -> a fingerprint of each of their strings."""
    for batch in _parts(batches):
        c = _columns([batch])
        which, place, w = _string_prints(c["bytes"], c["more"])
        key = mix(w ^ mix(c["h1"].view(np.uint64)[which]))
        yield pa.RecordBatch.from_arrays([pa.array(c["k1"][which]), pa.array(c["k2"][which]), pa.array(c["lo"][which] + place), pa.array(key.view(np.int64))], names=["k1", "k2", "lo", "w"])


def _compress(batches):
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in _parts(batches):
        z = [press.compress(t) for t in _bytes(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(z, pa.binary())], names=["k1", "k2", "doc_id", "z"])


def _remove(batches):
    """Compressed texts with covered ranges -> what is left, and the removed runs."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in _parts(batches):
        out = [[], [], []]
        for z, cover in zip(batch.column("z").to_pylist(), batch.column("cover").to_pylist(), strict=True):
            text = plain.decompress(z)
            spans: list[list[int]] = []
            for r in sorted(cover or [], key=lambda r: r["lo"]):
                a, b = r["lo"], r["lo"] + r["more"] + MATCH
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            at, left = 0, []
            for a, b in spans:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            for col, x in zip(out, (len(text), [{"start": a, "end": b} for a, b in spans], b"".join(left)), strict=True):
                col.append(x)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], kind), pa.array(out[2], pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


class SuffixLevels:
    """The index family. Each level is a bucketed table (suffix, h, n) of distinct entries, sorted by suffix and
    fingerprint; a level of rank r holds 2**r batches.

    At a path the family lasts: a manifest there names its levels, the batches they hold and what each batch shared with
    others when it came. Manifests are numbered and put in place by a rename after what they name is complete, so
    whatever is lost on the way, the last manifest is true, and the batch is added again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or scratch_path(spark, "suffix-family")).rstrip("/")
        jvm = spark._jvm
        self._hadoop = lambda x: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}" if x else self.path)
        self._fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.version, self.levels, self.batches = 0, [], {}  # levels: rank, table, folder; batches: name, folder of its hits
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names = [x.getPath().getName() for x in self._fs.listStatus(self._hadoop(""))] if self._fs.exists(self._hadoop("")) else []
        found = [int(x[9:-5]) for x in names if x.startswith("manifest-") and x.endswith(".json")]
        if found:
            self.version = max(found)
            text = spark.read.option("wholetext", True).text(f"{self.path}/manifest-{self.version}.json").first()[0]
            state = json.loads(text)
            self.buckets, self.batches = state["buckets"], state["batches"]
            self.levels = [(rank, self._table(folder), folder) for rank, folder in state["levels"]]

    def _table(self, folder: str) -> str:
        name = f"suffix_level_{uuid.uuid4().hex[:12]}"
        self.spark.sql(
            f"CREATE TABLE {name} (suffix BINARY, h BIGINT, n BIGINT) USING parquet CLUSTERED BY (suffix, h) SORTED BY (suffix, h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return name

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name, folder = f"suffix_level_{uuid.uuid4().hex[:12]}", f"level-{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "suffix", "h").sortBy("suffix", "h").option("path", f"{self.path}/{folder}").saveAsTable(name)
        return name, folder

    def _commit(self) -> None:
        self.version += 1
        state = {"buckets": self.buckets, "levels": [[rank, folder] for rank, _, folder in self.levels], "batches": self.batches}
        aside, place = self._hadoop(f"aside-{uuid.uuid4().hex}"), self._hadoop(f"manifest-{self.version}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(aside, place):
            raise RuntimeError(f"another writer has made manifest {self.version} of {self.path}")

    def add(self, texts: DataFrame, batch: str | None = None) -> DataFrame:
        """Index a batch (one column of texts); returns the fingerprints it shares with itself or any level."""
        batch = batch or uuid.uuid4().hex
        if batch not in self.batches:
            rows = texts.mapInArrow(_suffixes, "suffix binary, h long").groupBy("suffix", "h").agg(F.count(F.lit(1)).alias("n"))
            table, folder = self._write(rows)
            own = self.spark.table(table)
            found = own.where("n > 1").select("h")
            for _, level, _ in self.levels:
                found = found.unionByName(own.select("suffix", "h").join(self.spark.table(level).select("suffix", "h"), ["suffix", "h"]).select("h"))
            hits = f"hits-{uuid.uuid4().hex}"
            found.write.parquet(f"{self.path}/{hits}")
            self.levels.append((0, table, folder))
            old = []
            while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
                (rank, a, fa), (_, b, fb) = self.levels.pop(), self.levels.pop()
                left, right = self.spark.table(a), self.spark.table(b).withColumnRenamed("n", "m")
                both = left.join(right, ["suffix", "h"], "full_outer")
                merged = both.select("suffix", "h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n"))
                self.levels.append((rank + 1, *self._write(merged)))
                old += [(a, fa), (b, fb)]
            self.batches[batch] = hits
            self._commit()
            for table, folder in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
                self._fs.delete(self._hadoop(folder), True)
        return self._hits(batch)

    def _hits(self, batch: str) -> DataFrame:
        return self.spark.read.schema("h long").parquet(f"{self.path}/{self.batches[batch]}")

    def matched(self) -> DataFrame:
        """Distinct fingerprints (h) that occur twice or more in all that was added."""
        every = None
        for batch in sorted(self.batches):
            every = self._hits(batch) if every is None else every.unionByName(self._hits(batch))
        return self.spark.createDataFrame([], "h long") if every is None else every.distinct()

    def close(self) -> None:
        """Forget the names of the tables; the files stay."""
        for _, table, _ in self.levels:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def delete(self) -> None:
        self.close()
        discard(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()


def remove_repeats(docs: DataFrame, batches: int = BATCHES, family: SuffixLevels | None = None, name: str = "batch", earlier: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs of bytes: start, end), kept (binary).

    The rows of docs itself are indexed, in batches by a hash of doc_id and text; how many only changes the work, not
    the result. Each batch reads docs again. With a family that lasts, docs are added to it under name, and
    what they share with its earlier batches goes from them too: earlier are those batches' documents, which are read for the
    ends of matches and are not in the result; without them only whole spans of anchors are found there.
    """
    spark = docs.sparkSession
    text = text_or_empty().alias("text")
    own = family or SuffixLevels(spark)
    part = F.pmod(F.xxhash64("doc_id", text_or_empty()), F.lit(batches))
    for k in range(batches):
        own.add((docs.where(part == k) if batches > 1 else docs).select(text), f"{name}-{k}-{batches}")
        release(spark)
    found = stored(own.matched(), "suffix-matches")
    if family is None:
        own.delete()
    release(spark)

    # the key of a document: equal rows share it, and then also all that is found for it
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(text_or_empty()).alias("k2"), text]
    keyed = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"))
    every = keyed.select("k1", "k2", "text")
    if earlier is not None:
        every = every.unionByName(earlier.select(*keys))
    places = every.mapInArrow(_places, "k1 long, k2 long, lo long, more int, h1 long, h2 long")
    # the gram print of an anchor has to be repeated; if its span print is too, all its strings are
    hot = places.join(found.select(F.col("h").alias("h1")), "h1", "left_semi")
    hot = stored(hot.join(found.select(F.col("h").alias("h2"), F.lit(True).alias("whole")), "h2", "left"), "suffix-places")
    release(spark)

    # the strings of the other anchors are looked up one by one, among themselves and among those of
    # one representative of each repeated span with the same gram
    part = hot.where("whole is null")
    one = hot.where("whole").groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2", "lo", "more")).alias("at"))
    one = one.join(part.select("h1").distinct(), "h1", "left_semi").select("at.*", "h1")
    ends = stored(part.select("k1", "k2", "lo", "more", "h1").unionByName(one), "suffix-ends")
    # contexts of one gram are compared in one place, unless they are many: those meet string by string
    many = ends.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("h1", F.lit(True).alias("hot"))
    # a table of its own: else its grouping would also deal the rows of the join, hot grams and all
    marked = ends.join(stored(many, "suffix-hot"), "h1", "left").withColumn("hot", F.col("hot").isNotNull())
    ranges = marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "more", "h1", "hot")).alias("ranges"))
    press = lambda df: df.select("k1", "k2", "text", "doc_id").mapInArrow(_compress, "k1 long, k2 long, doc_id long, z binary")
    zipped = press(keyed)
    texts = zipped if earlier is None else zipped.unionByName(press(earlier.select(*keys, F.col("doc_id").cast("long").alias("doc_id"))))
    some = texts.join(ranges, ["k1", "k2"]).select("k1", "k2", "z", "ranges")
    contexts = stored(some.mapInArrow(_contexts, "k1 long, k2 long, h1 long, hot boolean, lo long, more int, bytes binary"), "suffix-contexts")
    discard(spark, ends)
    release(spark)
    cold = contexts.where("not hot").drop("hot").repartition("h1").sortWithinPartitions("h1").mapInArrow(_compare, "k1 long, k2 long, lo long, more int")
    strings = stored(contexts.where("hot").drop("hot").mapInArrow(_strings, "k1 long, k2 long, lo long, w long"), "suffix-strings")
    twice = strings.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    held = strings.join(twice, "w", "left_semi").select("k1", "k2", "lo", F.lit(0).alias("more")).unionByName(cold)
    cover = hot.where("whole").select("k1", "k2", "lo", "more").unionByName(held)
    cover = stored(cover.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "more")).alias("cover")), "suffix-cover")
    discard(spark, strings, contexts, hot)
    release(spark)
    return zipped.join(cover, ["k1", "k2"], "left").select("doc_id", "z", "cover").mapInArrow(
        _remove, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE_SQL = None
