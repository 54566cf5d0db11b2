"""Sum-of-squares online packing of token sequences.

Each task packs the documents of its own input split, in order, with no shuffle. A level array
counts the open windows by fill. A document's full windows are cut off first; its rest goes to the
fill level that makes the sum of squared counts of partially filled windows smallest (completing a
window or joining a level that is rarely used is cheap, adding to a crowded one is dear), ties to the
fullest. A window leaves the level array when it is full.

Two bounds are ours: if ``max_open`` windows are open, the fullest window that the document can
complete takes its first part, so open windows (and their ids) stay bounded; and when the input of a
task ends, its open windows are joined whole where they fit together, and only what then is neither full nor as long as
a power of two is cut: the emptiest windows to fill up the fullest, the last one into powers of two. So nothing is padded.

Defined results for odd input: a null text is empty and yields the end id alone; a null doc_id is kept
as it is; repeated rows are separate documents; very long documents are cut; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .tokens import WordTokenizer, slices

CAPACITY = 2048
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Online packing of items (key, start, ids, total) into windows of one capacity."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = 256):
        self.capacity, self.max_open = capacity, max_open
        self.count = np.zeros(capacity + 1, np.int64)  # open windows by fill; 0 and capacity stay 0
        self.stacks: dict[int, list[list]] = {}
        self.open = 0

    def level(self, size: int) -> int:
        """The fill level to place an item of this size at; 0 opens a window."""
        n, cap = self.count, self.capacity
        fills = np.flatnonzero(n[: cap - size + 1])
        after = 2 * n[fills + size] + 1
        after[fills + size == cap] = 0
        change = after - (2 * n[fills] - 1)
        new = 2 * n[size] + 1
        if len(change):
            best = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[best] <= new:
                return int(fills[best])
        return 0

    def _put(self, fill: int, item: tuple):
        """Add an item to a window of this fill; returns the window's items if that completes it."""
        size = len(item[2])
        if fill:
            window = self.stacks[fill].pop()
            self.count[fill] -= 1
            self.open -= 1
        else:
            window = []
        window.append(item)
        if fill + size == self.capacity:
            return window
        self.stacks.setdefault(fill + size, []).append(window)
        self.count[fill + size] += 1
        self.open += 1
        return None

    def add(self, key, ids: np.ndarray):
        """Place a document; yields completed windows as lists of (key, start, ids, total)."""
        total, at, cap = len(ids), 0, self.capacity
        while total - at >= cap:
            yield [(key, at, ids[at : at + cap], total)]
            at += cap
        while at < total:
            size = total - at
            if self.open >= self.max_open:
                fills = np.flatnonzero(self.count)
                fits = fills[fills + size >= cap]
                if len(fits):
                    size = cap - int(fits[-1])  # the fullest window takes the first part
                    done = self._put(cap - size, (key, at, ids[at : at + size], total))
                else:  # all windows have more room than the document needs: the fullest one takes it
                    done = self._put(int(fills[-1]), (key, at, ids[at:], total))
            else:
                done = self._put(self.level(size), (key, at, ids[at : at + size], total))
            at += size
            if done:
                yield done

    def finish(self):
        """Windows for what is still open, without padding. Open windows are joined whole first, the fullest with the
        fullest that fits beside it; what is then complete, or as long as a power of two, is done. Of the others the
        emptiest is taken apart to fill up the fullest, and so on, and what is left of the last one is cut into powers of two."""
        cap = self.capacity
        pool = [(fill, k, w) for fill in sorted(self.stacks) for k, w in enumerate(self.stacks[fill])]
        left = []
        while pool:
            fill, _, window = pool.pop()
            while at := bisect_right(pool, cap - fill, key=lambda x: x[0]):
                more, _, other = pool.pop(at - 1)
                fill, window = fill + more, window + other
            if fill & (fill - 1):
                left.append((fill, window))
            else:
                yield window
        left.sort(key=lambda x: x[0])
        low, high = 0, len(left) - 1
        while low < high:
            room = cap - left[high][0]
            moved, rest = _cut(left[low][1], room)
            taken = min(room, left[low][0])
            left[high] = (left[high][0] + taken, left[high][1] + moved)
            left[low] = (left[low][0] - taken, rest)
            low += not rest
            if left[high][0] == cap:
                yield left[high][1]
                high -= 1
        if low == high:
            fill, window = left[low]
            for b in range(fill.bit_length() - 1, -1, -1):
                if fill >> b & 1:
                    part, window = _cut(window, 1 << b)
                    yield part
        self.__init__(self.capacity, self.max_open)


def _cut(window: list[tuple], room: int) -> tuple[list[tuple], list[tuple]]:
    """The first room ids of a window's pieces, and the pieces behind them."""
    k, head = 0, []
    while k < len(window) and room:
        key, start, ids, total = window[k]
        head.append((key, start, ids[:room], total))
        if len(ids) > room:
            return head, [(key, start + room, ids[room:], total), *window[k + 1 :]]
        room -= len(ids)
        k += 1
    return head, window[k:]


def _packer(path: str | None, capacity: int, with_ids: bool):
    def run(batches):
        tok, packer = WordTokenizer.shared(path), SumOfSquares(capacity)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        made = 0
        end = np.array([END_ID], np.uint32)

        def rows(windows):
            nonlocal made
            out = [[] for _ in range(8)]
            for window in windows:
                offset = 0
                for key, start, ids, total in window:
                    row = (key, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), total, base + made, offset, ids)
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                    offset += len(ids)
                made += 1
            cols = [pa.array(c, pa.int64()) for c in out[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in out[7]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for part in slices(texts):
                done = []
                for key, ids in zip(keys[part], tok.encode(texts[part]), strict=True):
                    done.extend(packer.add(key, np.concatenate([ids, end])))
                yield rows(done)
        yield rows(packer.finish())

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids as an array."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_packer(tokenizer, capacity, with_ids), PIECE + (", ids array<int>" if with_ids else ""))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


ORACLE_SQL = None
