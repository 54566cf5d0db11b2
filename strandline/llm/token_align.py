"""Alignment of two tokenizers over a corpus.

A text is cut into units at every single space or line feed that stands between two characters which are no white
space. Neither tokenizer joins anything across such a place (checked on the vocabulary of the second one), so the ids of
a text are those of its units, and a unit that comes often is encoded and aligned once in a block of texts.

A task reads its split in blocks of BLOCK_CHARS characters. For each block DuckDB gets the token intervals of its
distinct units as tables: an ASOF join finds the first token in which a token of the second tokenizer begins, another
one with its range condition finds those that begin inside of it, and window sums over shared ends number the groups. The block
gives rows of three kinds, which are written once: its id pairs with their counts, the pairs of each unit, and
its documents as lists of units. Spark adds up the counts of pairs over all blocks, marks the highest ones of each
id, deals them back to the blocks that have the pair, and there every document sums what its units have.

Nothing grows with the corpus but tables: a task holds one block, and a block only the counts of its own pairs.

Defined results for odd input: a null or empty text has no tokens, nor has one whose tokens in either tokenizer do not
give back space and text byte by byte (U+2581, for instance, cannot be told from a space): zeros and an
empty string; a null doc_id is kept as it is; repeated rows are documents of their own and count each; a text longer than
a block is a block of its own; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_CHARS = 16_000_000
#: Units encoded in one call, and units and documents in one row or batch of the written table.
LINE, ROW_UNITS, BATCH = 200, 20_000, 2_000
#: Units whose intervals are tables at one time.
TABLE_UNITS = 60_000
#: Bytes of a unit beyond which its lines go to the slower encoder.
LONG = 500
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
SMALL = re.compile(r"[ \n]\S+")

PARTS = pa.schema(
    [
        ("block", pa.int64()), ("kind", pa.int32()), ("at", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
        ("links", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("units", pa.list_(pa.int32())),
    ]
)
PARTS_SQL = (
    "block long, kind int, at long, a int, b int, n long, links array<int>, sizes array<int>, doc_id long, n_a long, n_b long, "
    "n_groups long, n_links long, groups_sha256 string, units array<int>"
)
PAIRS, UNITS, DOCS = 0, 1, 2
_HELD: dict = {}


def _bytes_of_letters() -> dict[str, int]:
    """The usual letters of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of every token."""

    def __init__(self, byte_path: str | None = None, piece_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        path = byte_path or public_tokenizers.path(BYTE_FILE)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = _bytes_of_letters()
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True  # their strings are plain text
        # the same ids several times as fast, where a merge's rank is the id of what it makes
        made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["model"]["merges"]]
        own = {bytes(letters[c] for c in t): k for t, k in model["model"]["vocab"].items() if all(c in letters for c in t)}
        ranked = [self.a.token_to_id(t) for t in made] == list(range(256, 256 + len(made)))
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for t, k in own.items() if k < 256 + len(made)}, special_tokens={}) if ranked else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path or public_tokenizers.path(PIECE_FILE))
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("only for second tokenizers without pieces across spaces and line feeds")
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.start = "x"  # a unit that takes the space which the second tokenizer sets in front
        self.start_ids = len(self.b.encode(self.start))

    @classmethod
    def shared(cls, *paths) -> Pair:
        if paths not in _HELD:
            _HELD[paths] = cls(*paths)
        return _HELD[paths]

    def _b_of(self, lines: list[str]) -> list[np.ndarray]:
        return [np.asarray(x[self.start_ids :], np.int64) for x in self.b.encode([self.start + x for x in lines], num_threads=1)]

    def _a_of(self, lines: list[str], short: bool = False) -> list[np.ndarray]:
        """short: lines without very long words, on which the fast encoder would take the square of their length."""
        if short and self.fast:
            return [np.asarray(self.fast.encode_ordinary(x), np.int64) for x in lines]
        return [np.asarray(x.ids, np.int64) for x in self.a.encode_batch_fast(lines, add_special_tokens=False)]

    def encode(self, plain: pa.Array, single: list[str]):
        """Of units with their first space or line feed: the ids in each tokenizer, one after the other, how many each unit
        has, whether its tokens give its bytes, and its bytes. single: units that are encoded alone, as they begin or
        end in other white space; they come after the plain ones."""
        ids, counts, good = ([], []), ([], []), []
        n = len(plain)
        offsets = np.frombuffer(plain.buffers()[1], np.int64, n + 1) if n else np.zeros(1, np.int64)
        data = memoryview(plain.buffers()[2] or b"")

        def alone(unit: str) -> None:
            (a,) = self._a_of([unit])
            (b,) = self._b_of([unit]) if unit[:1] != " " else [np.asarray(self.b.encode(unit[1:]), np.int64)]
            good.append(b"".join(map(self.a_bytes.__getitem__, a)) == unit.encode() == b"".join(map(self.b_bytes.__getitem__, b)))
            for x, all_ids, n in zip((a, b), ids, counts, strict=True):
                all_ids.append(x if good[-1] else x[:0])
                n.append([len(all_ids[-1])])

        for at in range(0, n, 64 * LINE):
            bounds = [*range(at, min(at + 64 * LINE, n), LINE), min(at + 64 * LINE, n)]
            wanted = [bytes(data[offsets[x] : offsets[y]]) for x, y in zip(bounds, bounds[1:], strict=False)]
            lines = [x.decode() for x in wanted]
            short = bool((np.diff(offsets[at : bounds[-1] + 1]) <= LONG).all())
            for x, y, want, found in zip(bounds, bounds[1:], wanted, zip(self._a_of(lines, short), self._b_of(lines), strict=True), strict=False):
                cuts = offsets[x + 1 : y + 1] - offsets[x]
                places = []
                for f, lens, parts in zip(found, (self.a_len, self.b_len), (self.a_bytes, self.b_bytes), strict=True):
                    ends = np.cumsum(lens[f])
                    at_cut = np.searchsorted(ends, cuts)
                    if b"".join(map(parts.__getitem__, f.tolist())) != want or (ends[at_cut] != cuts).any():
                        break
                    places.append(np.diff(at_cut + 1, prepend=0))
                if len(places) < 2:
                    for u in plain[x:y].to_pylist():
                        alone(u)
                    continue
                good.extend([True] * (y - x))
                for f, c, all_ids, out in zip(found, places, ids, counts, strict=True):
                    all_ids.append(f)
                    out.append(c)
        for u in single:
            alone(u)
        empty = np.empty(0, np.int64)
        flat, count = ([np.concatenate([empty, *x]).astype(np.int64) for x in y] for y in (ids, counts))
        size = np.concatenate([np.diff(offsets), np.array([len(u.encode()) for u in single], np.int64)])
        return flat, count, np.array(good, bool), size


def units_of(text: str) -> list:
    """The units of a text: a string without white space has a space in front that is left out, or begins with a line feed; any
    other unit is a tuple of its whole string."""
    words, gaps = text.split(), text.count(" ") + text.count("\n")
    if len(words) == gaps + 1 and len(text) == gaps + sum(map(len, words)):  # one of the two between any two words
        return words if "\n" not in text else text.replace("\n", " \n").split(" ")
    out = []
    for u in CUT.split(" " + text):
        out.append((u[1:] if u[0] == " " else u) if SMALL.fullmatch(u) else (u,))
    return out


#: The group of a token is the number of ends before its own that both tokenizers share.
ALIGN = """
CREATE OR REPLACE TEMP TABLE ta AS SELECT *, coalesce(sum(shared) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp
  FROM (SELECT a.*, (b.e IS NOT NULL)::INT AS shared FROM a LEFT JOIN b ON b.e = a.e);
CREATE OR REPLACE TEMP TABLE tb AS SELECT *, coalesce(sum(shared) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS grp
  FROM (SELECT b.*, (a.e IS NOT NULL)::INT AS shared FROM b LEFT JOIN a ON a.e = b.e);
CREATE OR REPLACE TEMP TABLE links AS
  SELECT a.unit, a.id AS a, b.id AS b FROM tb b ASOF JOIN ta a ON b.s >= a.s
  UNION ALL
  SELECT a.unit, a.id, b.id FROM ta a ASOF JOIN tb b ON a.s > b.s WHERE a.s < b.e;
"""


def _joined(strings: pa.Array, ends: np.ndarray, mark: str) -> pa.Array:
    """Strings joined run by run; a run begins where the one before it ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), strings), mark)


class Aligner:
    """Blocks of documents to rows of PARTS."""

    def __init__(self, pair: Pair):
        import duckdb

        self.pair = pair
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})

    def _table(self, name: str, ids: np.ndarray, count: np.ndarray, lens: np.ndarray, first: np.ndarray) -> None:
        """Register the token intervals of some units; first has the byte at which each unit begins."""
        end = np.cumsum(lens[ids])
        before = np.concatenate([[0], end])[np.cumsum(count) - count]  # bytes of the tokens in front of a unit
        end = end - np.repeat(before - first, count)
        unit = np.repeat(np.arange(len(count)), count)
        cols = {"unit": unit, "id": ids, "s": end - lens[ids], "e": end}
        self.con.register(name, pa.table({k: pa.array(x, pa.int32()) for k, x in cols.items()}))

    def _strings(self, n: int) -> tuple[pa.Array, np.ndarray]:
        """The groups of every unit as one string, and how many there are."""
        sides = []
        for name in ("ta", "tb"):
            got = self.con.sql(f"SELECT id, grp, unit FROM {name} ORDER BY e").to_arrow_table()
            ends = np.flatnonzero(np.diff(got["grp"].to_numpy(), append=-1))
            sides.append(_joined(pc.cast(got["id"].combine_chunks(), pa.string()), ends + 1, ","))
        count = np.bincount(got["unit"].to_numpy()[ends], minlength=n)
        return _joined(pc.binary_join_element_wise(*sides, "|"), np.cumsum(count), ";"), count

    def block(self, number: int, doc_ids: list, texts: list):
        index: dict = {}
        codes = []
        for k, text in enumerate(texts):
            texts[k] = None  # a text is not held once it is cut
            us = units_of(text) if text else []
            for u in set(us).difference(index):
                index[u] = len(index)
            codes.append(np.fromiter(map(index.__getitem__, us), np.int32, len(us)))
        # units that are encoded alone come last
        names = list(index)
        alone = np.fromiter((isinstance(u, tuple) for u in names), bool, len(names))
        order = np.argsort(alone, kind="stable")
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names))
        plain = pa.array([u if u[:1] == "\n" else " " + u for u in names if not isinstance(u, tuple)], pa.large_string())
        single = [u[0] for u in names if isinstance(u, tuple)]
        del index, names
        (ids_a, ids_b), (n_a, n_b), good, size = self.pair.encode(plain, single)
        del plain, single
        codes = [place[c] for c in codes]
        codes = [c if good[c].all() else c[:0] for c in codes]
        times = np.bincount(np.concatenate([np.empty(0, np.int32), *codes]), minlength=len(good))
        strings, n_groups, links = [], [], []
        of_a, of_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
        for lo in range(0, len(good), TABLE_UNITS):
            hi = min(lo + TABLE_UNITS, len(good))
            first = np.cumsum(size[lo:hi]) - size[lo:hi]
            self._table("a", ids_a[of_a[lo] : of_a[hi]], n_a[lo:hi], self.pair.a_len, first)
            self._table("b", ids_b[of_b[lo] : of_b[hi]], n_b[lo:hi], self.pair.b_len, first)
            self.con.execute(ALIGN)
            text, n = self._strings(hi - lo)
            strings.append(text)
            n_groups.append(n)
            found = self.con.sql("SELECT unit, a, b FROM links ORDER BY unit").to_arrow_table()
            unit, x, y = (found[c].to_numpy() for c in ("unit", "a", "b"))
            used = times[unit + lo] > 0  # not what only texts without tokens have
            links.append((unit[used] + lo, y[used].astype(np.int64) << 32 | x[used]))
            self.con.execute("DROP TABLE ta; DROP TABLE tb; DROP TABLE links")
            self.con.unregister("a")
            self.con.unregister("b")
        none = np.empty(0, np.int64)
        unit, pair = (np.concatenate([none, *x]) for x in (zip(*links, strict=True) if links else ((), ())))
        pairs, at = np.unique(pair, return_inverse=True)
        yield from self._pairs(number, pairs, np.bincount(at, times[unit], len(pairs)).astype(np.int64))
        n_links = np.bincount(unit, minlength=len(good))
        yield from self._units(number, at.astype(np.int32), n_links)
        del links, unit, pair, at, ids_a, ids_b
        n_groups = np.concatenate([none, *n_groups])
        yield from self._docs(number, doc_ids, codes, (n_a, n_b, n_groups, n_links), pa.chunked_array(strings, pa.string()))
        pa.default_memory_pool().release_unused()

    @staticmethod
    def _pairs(number: int, pairs: np.ndarray, n: np.ndarray):
        for x in range(0, len(pairs), 50_000):
            part = pairs[x : x + 50_000]
            yield _rows(number, PAIRS, np.arange(x, x + len(part)), a=part & 0xFFFFFFFF, b=part >> 32, n=n[x : x + 50_000])

    @staticmethod
    def _units(number: int, links: np.ndarray, sizes: np.ndarray):
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for x in range(0, len(sizes), ROW_UNITS):
            part = sizes[x : x + ROW_UNITS]
            yield _rows(number, UNITS, [x], links=[links[ends[x] : ends[x + len(part)]]], sizes=[part.astype(np.int32)])

    @staticmethod
    def _docs(number: int, doc_ids: list, codes: list[np.ndarray], counts: tuple, strings: pa.ChunkedArray):
        strings = np.array(strings.to_pylist(), object)
        for x in range(0, len(doc_ids), BATCH):
            part = codes[x : x + BATCH]
            n = [[int(c[p].sum()) for p in part] for c in counts]
            sha = [hashlib.sha256(";".join(strings[p]).encode()).hexdigest() if len(p) else "" for p in part]
            yield _rows(number, DOCS, range(x, x + len(part)), doc_id=doc_ids[x : x + BATCH], n_a=n[0], n_b=n[1], n_groups=n[2], n_links=n[3], groups_sha256=sha, units=part)


def _rows(number: int, kind: int, at, **columns) -> pa.RecordBatch:
    n = len(at)
    own = {"block": pa.array([number] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32()), "at": at} | columns
    cols = [pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in PARTS]
    return pa.RecordBatch.from_arrays(cols, schema=PARTS)


def block_rows(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows that all blocks give, as a written table: id pairs, pairs of units, documents. Every later step reads this, so it
    does not matter how rows were dealt to tasks."""

    def run(batches):
        task, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0
        aligner = Aligner(Pair.shared(byte_path, piece_path))
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                for key, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if ids and size + len(text or "") > block_chars:
                        yield from aligner.block(task << 24 | seq, ids, texts)
                        seq, ids, texts, size = seq + 1, [], [], 0
                    ids.append(key)
                    texts.append(text)
                    size += len(text or "")
        if ids:
            yield from aligner.block(task << 24 | seq, ids, texts)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(slim.mapInArrow(run, PARTS_SQL), "aligned-blocks")


def pair_counts(parts: DataFrame) -> DataFrame:
    """a, b, n (links of the whole corpus that hold the pair) and best (whether no other pair of this b has more)."""
    total = parts.where(F.col("kind") == PAIRS).groupBy("a", "b").agg(F.sum("n").alias("n"))
    return total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _sums(batches):
    """Rows sorted by block and kind -> documents with the sums over their links."""
    block, total, best, unit_total, unit_best = None, [], [], [], []
    for batch in batches:
        kinds, blocks = batch["kind"].to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(blocks) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
            if lo == hi:
                continue
            part, kind = batch.slice(lo, hi - lo), kinds[lo]
            if blocks[lo] != block:
                block, total, best, unit_total, unit_best = blocks[lo], [], [], [], []
            if kind == PAIRS:
                total.append(part["n"].to_numpy())
                best.append(part["best"].to_numpy(zero_copy_only=False).astype(np.int64))
            elif kind == UNITS:
                total, best = [np.concatenate([*total, np.empty(0, np.int64)])], [np.concatenate([*best, np.empty(0, np.int64)])]
                for links, sizes in zip(part["links"], part["sizes"], strict=True):
                    at = links.values.to_numpy()
                    ends = np.cumsum(sizes.values.to_numpy())
                    for of, out in ((total[0], unit_total), (best[0], unit_best)):
                        run = np.concatenate([[0], np.cumsum(of[at])])
                        out.append(np.diff(run[np.concatenate([[0], ends])]))
            else:
                unit_total, unit_best = ([np.concatenate([*x, np.empty(0, np.int64)])] for x in (unit_total, unit_best))
                units = [x.values.to_numpy() for x in part["units"]]
                sums = [pa.array([int(of[0][u].sum()) for u in units], pa.int64()) for of in (unit_best, unit_total)]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in RESULT[:5]), *sums, part["groups_sha256"]], names=RESULT)


RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(parts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """RESULT of every document of block_rows: tokens, groups and links, how many links are the best of their b id, and the
    sum of the counts of all its links."""
    counts = (pair_counts(parts) if pairs is None else pairs).select("a", "b", F.col("n").alias("sum_n"), "best")
    # a pair stands once in a block, so even the commonest one has no more rows than there are blocks
    own = parts.where(F.col("kind") == PAIRS).join(counts, ["a", "b"]).withColumn("n", F.col("sum_n"))
    rest = parts.where(F.col("kind") != PAIRS).withColumn("best", F.lit(None).cast("boolean"))
    names = ["block", "kind", "at", "n", "best", "links", "sizes", *RESULT[:5], "groups_sha256", "units"]
    rows = own.select(names).unionByName(rest.select(names)).repartition("block").sortWithinPartitions("block", "kind", "at")
    kinds = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in RESULT)
    return rows.mapInArrow(_sums, kinds)


def align(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    return aligned(block_rows(docs, byte_path, piece_path, block_chars))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read(spark, sf_dir, "documents"))


ORACLE_SQL = None
