"""Token ids by a word-level tokenizer file, with a bounded cache of words.

The tokenizers meant here drop white space and never join characters across it, so a text's ids are
those of its words one after the other. Most words of a corpus are frequent ones: each worker encodes
a word once while it stays in the cache, and looks it up after that. Many texts are taken at once, as
one run of bytes: NumPy parts letters from the punctuation after them, Arrow splits words and numbers
the different ones, and only those are looked up.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_FILE = "word_bpe_49k.json"
_PART = "\x01"
_HELD: dict = {}
_LINE = 200  # words encoded in one line
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: By byte: 1 for what ends a token when punctuation follows, 2 for that punctuation.
_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
_KIND[list(b"!#$%&()*+,-./:;=?@[]^_`{|}~")] = 2


def _strings(texts: pa.Array | Sequence[str | None]) -> pa.Array:
    """The texts as an Arrow array of strings, null ones empty."""
    if not isinstance(texts, pa.Array):
        texts = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.binary()).view(pa.string())
    return texts.fill_null("").cast(pa.string())


def slices(texts: pa.Array, most: int = 16_000_000) -> Iterator[slice]:
    """Runs of texts of at most so many bytes together; a longer text is one alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        last = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield slice(at, last)
        at = last


def _words(texts: pa.Array) -> pa.ListArray:
    """The words of each text, ASCII letters in lower case as the tokenizer's normaliser has them, and punctuation parted
    from a letter or digit before it, which ends a token. Texts are split as they are where a special token could stand in
    them, since those are matched before normalising, or combining marks, which some small letters alone are composed with."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    plain = _LOWER[raw]
    kind = _KIND[plain]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # the letters from U+00C0 to U+00FF; two signs stand among them
    kind[latin[(raw[latin] != 0x97) & (raw[latin] != 0xB7)]] = 1
    cuts = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    marks = np.flatnonzero((raw == 0xCC) | (raw == 0xCD))
    specials = np.flatnonzero((raw[:-1] == 0x3C) & (raw[1:] == 0x7C))
    if len(marks) or len(specials):
        kept = np.zeros(len(texts) + 1, bool)
        kept[np.searchsorted(at, np.concatenate([marks, specials]), "right") - 1] = True
        for k in np.flatnonzero(kept):
            plain[at[k] : at[k + 1]] = raw[at[k] : at[k + 1]]
        cuts = cuts[~kept[np.searchsorted(at, cuts, "right") - 1]]
    data = np.insert(plain, cuts, 0x20)
    at = (at + np.searchsorted(cuts, at)).astype(np.int32)
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(data)]))


def tokenizer_path(name: str = WORD_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str | None = None, cache_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or tokenizer_path())
        self.limit = cache_words
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        if ids("Some Word,") != ids("some") + ids("word") + ids(",") or len(ids(_PART)) != 1:
            raise ValueError("only for tokenizers that lower the case, drop white space and part words from punctuation")
        self.part = ids(_PART)[0]
        self.words = pa.array([], pa.binary())
        self.lens = np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)

    @classmethod
    def shared(cls, path: str | None = None) -> WordTokenizer:
        """The one of this worker process, with the words that earlier tasks have met."""
        if path not in _HELD:
            _HELD[path] = cls(path)
        return _HELD[path]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has. Words are encoded in long
        lines, parted by a word that stands for nothing else; those that hold its character go alone."""
        alone = [k for k, w in enumerate(words) if _PART in w]
        own = [self.tok.encode(words[k], add_special_tokens=False).ids for k in alone]
        for k in alone:
            words[k] = ""
        lines = [f" {_PART} ".join(words[a : a + _LINE]) for a in range(0, len(words), _LINE)]
        got = np.fromiter(chain.from_iterable([*x.ids, self.part] for x in self.tok.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        parts = np.flatnonzero(got == self.part)
        if len(parts) != len(words):
            raise ValueError("the parting word is not one token of its own")
        lens = np.diff(parts, prepend=-1).astype(np.int32) - 1
        flat = got[got != self.part]
        if alone:
            counts = [len(x) for x in own]
            flat = np.insert(flat, np.repeat(np.cumsum(lens)[alone], counts), np.fromiter(chain.from_iterable(own), np.uint32))
            lens[alone] = counts
        return flat, lens

    def _codes(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of different words, and by number how many ids a word has, and all ids in that order."""
        found = pc.index_in(words, value_set=self.words)
        codes = found.fill_null(-1).to_numpy().copy()
        new = words.filter(found.is_null())
        if not len(new):
            return codes, self.lens, self.flat
        codes[codes < 0] = len(self.words) + np.arange(len(new))
        flat, lens = self._ids([w.decode("utf-8", "replace") for w in new.to_pylist()])
        flat, lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
        if len(self.words) < self.limit:  # else the cache is full of words that came early, the frequent ones among them
            self.words, self.flat, self.lens = pa.concat_arrays([self.words, new]), flat, lens
        return codes, lens, flat

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; None is an empty text."""
        if not len(texts):
            return []
        split = _words(_strings(texts))
        words = split.flatten().view(pa.binary()).dictionary_encode()
        codes, lens, flat = self._codes(words.dictionary)
        starts = np.cumsum(lens, dtype=np.int64) - lens
        numbers = codes[words.indices.to_numpy()]
        n = lens[numbers]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        ids = flat[np.repeat(starts[numbers] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
