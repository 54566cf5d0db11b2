"""Best-first encoding of many sequences at once by NumPy: what ``Vocabulary.encode_best`` does, one merge in every sequence of a
block at a time. Few sequences that are left once most of a block is done go to ``encode_best`` itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strandline.operators.vocabulary import Vocabulary

#: Items of a block, pairs of tokens up to which rules are looked up by place, and the sequences that are few.
ITEMS, DENSE, FEW = 200_000, 1 << 22, 16
IN, BEHIND, NEXT = 0, 1, 2


def atom_tokens(vocab: Vocabulary):
    """A function from code tuples (an Arrow list array) to tokens, items x slots, 0 behind shorter tuples."""
    null, slots = np.iinfo(np.int64).min, max(1, vocab.slots)
    books = [sorted((null if c is None else c, t) for t, (slot, c) in enumerate(vocab.atoms[1:], 1) if slot == k) for k in range(slots)]

    def run(items) -> np.ndarray:
        wide, codes = items.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), items.flatten().cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)
        state = np.repeat(np.arange(len(items)), wide)
        slot = np.arange(len(codes)) - np.repeat(np.cumsum(wide) - wide, wide)
        if len(slot) and slot.max() >= slots:
            raise KeyError(f"slot {slot.max()} is not in the vocabulary")
        tokens = np.zeros((len(items), slots), np.int32)
        for k, book in enumerate(books):
            own = slot == k
            if not own.any():
                continue
            known, number = np.array([c for c, _ in book], np.int64), np.array([t for _, t in book], np.int32)
            at = np.minimum(np.searchsorted(known, codes[own]), len(known) - 1)
            if (known[at] != codes[own]).any():
                raise KeyError(f"a code of slot {k} is not in the vocabulary")
            tokens[state[own], k] = number[at]
        return tokens

    return run


class Encoder:
    """Links of all sequences of a block, one after the other; places as in ``vocabulary._Encoder``."""

    def __init__(self, vocab: Vocabulary):
        n, size = len(vocab.atoms), len(vocab)
        self.vocab, self.size = vocab, size
        self.low, self.high = (np.array([*[0] * n, *[r[side] for r in vocab.rules]], np.int32) for side in (0, 1))
        self.weight = np.array([*[-np.inf] * n, *vocab.priority], float)
        keys = np.array([a * size + b for a, b in vocab.rank], np.int64)
        made = np.array(list(vocab.rank.values()), np.int32)
        if size * size <= DENSE:
            self.table = np.zeros(size * size, np.int32)
            self.table[keys] = made
        else:
            order = np.argsort(keys)
            self.table, self.keys, self.made = None, np.append(keys[order], -1), np.append(made[order], 0)

    def _rule(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two make, or 0."""
        key = np.minimum(a, b).astype(np.int64) * self.size + np.maximum(a, b)
        if self.table is not None:
            return self.table[key]
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.made[at], 0)

    def _best(self, share: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs in reading order, the first of the best score."""
        best, how = np.full(len(share), -np.inf), np.zeros(len(share), np.int32)
        for a, b in pairs:
            token = self._rule(a, b)
            score = np.where(token > 0, self.weight[token] * share, -np.inf)
            better = score > best
            best[better], how[better] = score[better], token[better]
        return best, how

    def _look(self, k: np.ndarray) -> None:
        own, behind, slot = self.tokens[:, k], self.behind[k], self.slot[k]
        width = self.wide[k]
        s = range(len(own))
        with np.errstate(divide="ignore"):
            self.score[IN, k], self.how[IN, k] = self._best(2 / width, [(own[i], own[j]) for i in s for j in s if i < j])
            self.score[BEHIND:, k] = -np.inf
            full = (behind >= 0) & (slot > 0)
            x = np.flatnonzero(full)
            a, b = own[:, x], self.tokens[:, behind[x]]
            self.score[BEHIND, k[x]], self.how[BEHIND, k[x]] = self._best(1 / width[x], [(a[i], slot[x]) for i in s])
            self.score[NEXT, k[x]], self.how[NEXT, k[x]] = self._best(1 / self.wide[behind[x]], [(b[i], slot[x]) for i in s])
            x = np.flatnonzero((behind >= 0) & (slot == 0))
            a, b = own[:, x], self.tokens[:, behind[x]]
            self.score[BEHIND, k[x]], self.how[BEHIND, k[x]] = self._best(1 / (width[x] * self.wide[behind[x]]), [(a[i], b[j]) for i in s for j in s])
        self.top[k] = self.score[:, k].max(0)

    def _without(self, k: np.ndarray, token: np.ndarray) -> None:
        """Take a token out of every state; what is left closes up."""
        own = self.tokens[:, k]
        found = np.zeros(len(k), bool)
        for i in range(len(own)):
            found |= own[i] == token
            own[i] = np.where(found, own[i + 1] if i + 1 < len(own) else 0, own[i])
        self.tokens[:, k] = own
        self.wide[k] -= found

    def _merge(self, k: np.ndarray, place: np.ndarray, token: np.ndarray) -> None:
        low, high = self.low[token], self.high[token]
        x = place == IN
        j = k[x]
        self._without(j, low[x])
        self._without(j, high[x])
        self.tokens[1:, j] = self.tokens[:-1, j]
        self.tokens[0, j] = token[x]
        self.wide[j] += 1
        x = (place != IN) & (self.slot[k] == 0)
        j, a, b = k[x], low[x], high[x]
        y = self.behind[j]
        ahead = (self.tokens[:, j] == a).any(0) & (self.tokens[:, y] == b).any(0)
        self._without(j, np.where(ahead, a, b))
        self._without(y, np.where(ahead, b, a))
        held = (place != IN) & ~x
        self.slot[j] = token[x]
        j = k[held]
        want = np.where(self.slot[j] == low[held], high[held], low[held])
        self._without(np.where(place[held] == BEHIND, j, self.behind[j]), want)
        self.slot[j] = token[held]

    def _tidy(self, near: np.ndarray) -> None:
        """near: five links in a row or -1 (rows), of some sequences; links that disappear become -1."""
        again = np.arange(near.shape[1])
        while len(again):
            changed = np.zeros(len(again), bool)
            for row in near:
                k = row[again]
                e = np.flatnonzero((k >= 0) & (self.wide[k] == 0))
                f = self.front[k[e]]
                e = e[(f >= 0) & (self.slot[f] > 0)]
                j = k[e]
                f = self.front[j]
                self.tokens[0, j], self.wide[j], self.slot[f] = self.slot[f], 1, 0
                changed[e] = True
            for row in near:
                k = row[again]
                e = np.flatnonzero((k >= 0) & (self.wide[k] == 0) & (self.slot[k] == 0))
                e = e[self.behind[k[e]] >= 0]
                j = k[e]
                f, b = self.front[j], self.behind[j]
                self.front[b] = f
                self.behind[f[f >= 0]] = b[f >= 0]
                self.top[j], self.score[:, j], self.gone[j] = -np.inf, -np.inf, True
                row[again[e]] = -1
                changed[e] = True
            again = again[changed]

    def encode(self, tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all sequences one after the other, and how many each has. tokens: items x slots; sizes: items of a sequence."""
        n = len(tokens)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        first = tokens
        self.tokens = tokens.T.copy()
        self.wide = (self.tokens > 0).sum(0)
        self.slot = np.zeros(n, np.int32)
        self.front, self.behind = np.arange(n) - 1, np.arange(n) + 1
        some = sizes > 0
        self.front[begin[some]], self.behind[ends[some] - 1] = -1, -1
        self.score, self.how, self.top = np.full((3, n), -np.inf), np.zeros((3, n), np.int32), np.full(n, -np.inf)
        self.gone = np.zeros(n, bool)
        self._look(np.arange(n))
        left, few = np.flatnonzero(some), np.zeros(0, int)
        whole, slow = -1, {}
        while len(left):
            if whole < 0 or 2 * len(left) < whole:  # the states of the sequences that are not done
                if whole >= 0 and len(left) <= FEW:
                    few = left
                    break
                whole, group = len(left), left
                at = np.repeat(begin[left] - np.cumsum(sizes[left]) + sizes[left], sizes[left]) + np.arange(sizes[left].sum())
                cuts = np.cumsum(sizes[left]) - sizes[left]
                owner = np.repeat(np.arange(len(left)), sizes[left])
            top = self.top[at]
            most = np.maximum.reduceat(top, cuts)
            hit = np.flatnonzero((top == most[owner]) & (top > -np.inf))
            mine = owner[hit]
            new = np.ones(len(hit), bool)
            new[1:] = mine[1:] != mine[:-1]
            k = at[hit[new]]
            left = group[mine[new]]
            if not len(k):
                break
            place = self.score[:, k].argmax(0)
            self._merge(k, place, self.how[place, k])
            f, b = self.front[k], self.behind[k]
            near = np.stack([np.where(f >= 0, self.front[f], -1), f, k, b, np.where(b >= 0, self.behind[b], -1)])
            empty = np.flatnonzero(((near >= 0) & (self.wide[near] == 0)).any(0))
            if len(empty):
                part = near[:, empty]
                self._tidy(part)
                near[:, empty] = part
            self._look(near[near >= 0])
        for q in few:
            states = [[int(t) for t in s if t] for s in first[begin[q] : ends[q]]]
            slow[int(q)] = self.vocab.encode_best(states)
        out = np.concatenate([self.tokens, self.slot[None]]).T
        out[self.gone] = 0
        seq = np.repeat(np.arange(len(sizes)), sizes)
        held = out > 0
        counts = np.bincount(seq, held.sum(1), len(sizes)).astype(np.int64)
        flat = out[held]
        if slow:
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for q, own in slow.items():
                parts[q], counts[q] = np.array(own, np.int32), len(own)
            flat = np.concatenate(parts)
        return flat, counts


def encoded(vocab: Vocabulary, key: str, by_item: bool = False):
    """For mapInArrow: key and tokens from key and feats; by_item, every item by itself."""
    atoms = atom_tokens(vocab)

    def run(batches):
        encoder = Encoder(vocab)
        for batch in batches:
            ends = np.cumsum(batch["feats"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            row = 0
            while row < batch.num_rows:
                end = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + ITEMS, "right")))
                part = batch.slice(row, end - row)
                sizes = part["feats"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                tokens = atoms(part["feats"].flatten())
                flat, counts = encoder.encode(tokens, np.ones(len(tokens), np.int64) if by_item else sizes)
                if by_item:
                    total = np.concatenate([[0], np.cumsum(counts)])
                    cuts = total[np.concatenate([[0], np.cumsum(sizes)])]
                else:
                    cuts = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([part[key], pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))], names=[key, "tokens"])
                row = end

    return run
