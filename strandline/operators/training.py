"""Training of the merge vocabulary on tables: sequences never leave the executors.

The corpus is a table of distinct sequences with their counts. A second table has the masses of pairs, as increments: a first
count, then what each merge changed.

Merges depend on each other, so a round guesses the next few: the pair of largest mass, which is known, and after it pairs
that share no token with each other. Tasks read the sequences, make the merges one after the other, each in some ten thousand
sequences at once by NumPy, and write what each changes. One query then gives the pairs of largest mass after each of the
merges, and the guesses hold as long as the next one is the true maximum; what comes after the first wrong guess is left out by
its number. So the log is that of merging one by one, whatever was guessed. The driver holds the rules, and of the pairs some
hundred with the largest masses.

Merges that hold are made again by every task that reads the sequences, until there are REWRITE of them: then the sequences
are written anew. A round that is lost runs again from tables; a whole training goes on from its log (``guide``).

Masses are summed as whole numbers over a common denominator and rounded to nine digits before they are compared, so that equal
ones are ties in whatever order they were summed; ties go to the smallest pair. Null, empty and repeated sequences: a null or empty one has no pairs, equal ones are counted together.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from strandline.operators.encoding import atom_tokens
from strandline.operators.tables import discarded, exists, kept, named
from strandline.operators.vocabulary import Vocabulary, from_table, vocabulary_table

#: Candidates that the driver gets in a round, the most merges of a round, merges after which sequences are written anew,
#: and rounds after which the increments of masses are summed up.
CANDIDATES, AHEAD, REWRITE, COMPACT = 256, 24, 20, 5
#: Sequences side by side as bytes, a block of them a row: nothing is converted item by item on the way to a task and back.
SEQUENCES = "n binary, sizes binary, tokens binary, between binary"
CHANGES = "step int, a int, b int, value double, what string"
NAMES = ["step", "a", "b", "value", "what"]
KINDS = ("same_action", "action_context", "adjacent_actions")
LOG = "step int, new_token int, left int, right int, priority double, affected_sequences long"
#: Changes that a task holds before it hands them on, states that it takes at once, states whose pairs are made at once, and how
#: many pairs of tokens there may be for sums by place instead of by sorting.
HELD, STATES, PART, DENSE = 2_000_000, 500_000, 8_192, 1 << 22


class _Block:
    """Sequences side by side in NumPy: tokens (slots x states, 0 where nothing is), between (the token in the slot behind a
    state, or 0), last (whether a state ends its sequence), seq (of which sequence it is) and n (how often that one occurs).

    The merges are those of ``Chain``, made in all sequences at once. The order of tokens in a state, of which no two are
    equal, has no bearing on them."""

    def __init__(self, tokens: np.ndarray, between: np.ndarray, sizes: np.ndarray, n: np.ndarray):
        self.tokens, self.between, self.n = tokens, between, n
        self.seq = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.last = np.zeros(len(between), bool)
        self.last[np.cumsum(sizes) - 1] = True
        self.empty = _widths(tokens) == 0

    def __len__(self) -> int:
        return len(self.between)

    def _near(self, at: np.ndarray) -> np.ndarray:
        """These states and the ones next to them, as flags."""
        out = np.zeros(len(self), bool)
        out[at] = True
        out[at[~self.last[at]] + 1] = True
        front = at[at > 0] - 1
        out[front[~self.last[front]]] = True
        return out

    def places(self, low: int, high: int, cross: bool) -> np.ndarray:
        one, two = self._holds(low), self._holds(high)
        out = one & two
        if cross and len(self) > 1:
            k = np.flatnonzero(((one[:-1] & two[1:]) | (two[:-1] & one[1:])) & ~self.last[:-1])
            k = k[self.between[k] == 0]
            for t, other in ((low, two), (high, one)):
                j = np.flatnonzero(self.between[:-1] == t)
                k = np.concatenate([k, j[other[j] | other[j + 1]]])
            out[k] = out[k + 1] = True
        return np.flatnonzero(out)

    def _holds(self, token) -> np.ndarray:
        """Whether a state has the token; row by row, which is faster than a reduction over a short axis."""
        out = self.tokens[0] == token
        for row in self.tokens[1:]:
            out |= row == token
        return out

    def _has(self, at: np.ndarray, token) -> np.ndarray:
        out = self.tokens[0].take(at) == token
        for row in self.tokens[1:]:
            out |= row.take(at) == token
        return out

    def _replace(self, at: np.ndarray, token, by=0) -> None:
        for row in self.tokens:
            row[at[row.take(at) == token]] = by

    def apply(self, low: int, high: int, token: int, cross: bool, places: np.ndarray) -> dict[str, int]:
        """Counts by kind of merge. What is done at a place depends on the place in front of it alone, so of every run of
        neighbouring places the first ones go together, then the second ones, and so on."""
        made = dict.fromkeys(KINDS, 0)
        starts = np.ones(len(places), bool)
        starts[1:] = (np.diff(places) != 1) | self.last[places[:-1]]
        turn = np.arange(len(places))
        turn -= np.maximum.accumulate(np.where(starts, turn, 0))
        left, wave = places, 0
        while len(left):
            now, rest = left[turn == wave], turn > wave
            left, turn, wave = left[rest], turn[rest], wave + 1
            if low != high:
                k = now[self._has(now, low) & self._has(now, high)]
                self._replace(k, high)
                self._replace(k, low, token)
                made["same_action"] += self._times(k)
            if not cross:
                continue
            now = now[~self.last[now]]
            k = now[self.between[now] == 0]
            for x, y in ((low, high), (high, low)):
                hit = self._has(k, x) & self._has(k + 1, y)
                j, k = k[hit], k[~hit]
                self._replace(j, x)
                self._replace(j + 1, y)
                self.between[j] = token
                made["adjacent_actions"] += self._times(j)
            # slots that held something before, and not the new token
            for held, want in ((low, high), (high, low)):
                k = now[self.between[now] == held]
                for step in (0, 1):
                    hit = self._has(k + step, want)
                    j, k = k[hit], k[~hit]
                    self._replace(j + step, want)
                    self.between[j] = token
                    made["action_context"] += self._times(j)
        self.empty[places] = _widths(self._states(places)) == 0
        return {kind: m for kind, m in made.items() if m}

    def _states(self, at: np.ndarray) -> np.ndarray:
        return np.stack([row.take(at) for row in self.tokens])

    def _times(self, at: np.ndarray) -> int:
        return int(self.n[self.seq[at]].sum())

    def empties(self, places: np.ndarray) -> np.ndarray:
        """Empty states of the sequences that have one of these places."""
        at = np.flatnonzero(self.empty)
        if len(at):
            touched = np.zeros(len(self.n), bool)
            touched[self.seq[places]] = True
            at = at[touched[self.seq[at]]]
        return at

    def tidy(self, touched: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """``Chain.tidy`` in some sequences; flags of states without those that disappear."""
        while True:
            at = np.flatnonzero(self.empty)
            at = at[touched[self.seq[at]]]
            k = at[at > 0]
            k = k[~self.last[k - 1] & (self.between[k - 1] != 0)]
            self.tokens[0, k], self.between[k - 1], self.empty[k] = self.between[k - 1], 0, False
            gone = at[self.empty[at] & (self.between[at] == 0) & ~self.last[at]]
            if len(gone):
                keep = np.ones(len(self), bool)
                keep[gone] = False
                self.tokens = np.stack([row[keep] for row in self.tokens])
                self.between, self.seq, self.last, self.empty, flags = (x[keep] for x in (self.between, self.seq, self.last, self.empty, flags))
            if not len(k) and not len(gone):
                return flags

    def merge(self, low: int, high: int, token: int, cross: bool, before=None, after=None):
        """Merge a pair wherever it occurs; counts by kind, and of the sequences that have a place of it. before and after are
        called with the flags of the states around what changes."""
        places = self.places(low, high, cross)
        if not len(places):
            return None
        flags = self._near(np.concatenate([places, self.empties(places)]))
        touched = np.zeros(len(self.n), bool)
        touched[self.seq[places]] = True
        if before:
            before(self, flags)
        made = self.apply(low, high, token, cross, places)
        flags = self.tidy(touched, flags) if self.empty.any() else flags
        if after:
            after(self, flags)
        made["sequences"] = int(self.n[touched].sum())
        return made

    def masses(self, size: int, scale: int, cross: bool, barred: np.ndarray | None, flags: np.ndarray | None = None):
        """Pairs (first * size + second) and masses times scale, of all groups or of those that have a flagged state."""
        whole = np.rint if scale > 1 else lambda x: x
        wide = np.arange(len(self.tokens) + 1).clip(1)  # by number of tokens; without any there is no pair, whatever the weight
        inside, beside, across = whole(2 * scale / wide), whole(scale / wide), whole(scale / (wide[:, None] * wide)).ravel()
        i, j = np.triu_indices(len(self.tokens), 1)

        def states(at):
            x = self._states(at)
            return x if barred is None else np.where(barred[x], 0, x)

        def within(at):
            x = states(at)
            w = inside[_widths(x)] * self.n[self.seq[at]]
            return ((x * np.int64(size))[i] + x[j]).ravel(), np.tile(w, len(i))

        def free(at):
            x, y = states(at), states(at + 1)
            w = across[_widths(x) * len(wide) + _widths(y)] * self.n[self.seq[at]]
            return ((x * np.int64(size))[:, None] + y).ravel(), np.tile(w, len(x) * len(y))

        def held(at):
            t = self.between[at] if barred is None else np.where(barred[self.between[at]], 0, self.between[at])
            both = np.concatenate([states(at), states(at + 1)])
            n, half = self.n[self.seq[at]], len(both) // 2
            w = [beside[_widths(x)] * n for x in (both[:half], both[half:])]
            return (both * np.int64(size) + t).ravel(), np.concatenate([np.tile(x, half) for x in w])

        kinds = [(within, np.arange(len(self)) if flags is None else np.flatnonzero(flags))]
        if cross:
            inner = ~self.last
            if flags is not None:
                inner[:-1] &= flags[:-1] | flags[1:]
            k = np.flatnonzero(inner)
            slot = self.between[k] != 0
            kinds += [(free, k[~slot]), (held, k[slot])]
        step = max(PART, size * size // 8)  # so much at a time as stays in a cache
        return _folded((f(at[k : k + step]) for f, at in kinds for k in range(0, len(at), step)), size)


def _widths(tokens: np.ndarray) -> np.ndarray:
    """How many tokens a state has."""
    out = np.zeros(tokens.shape[1], np.int64)
    for row in tokens:
        out += row != 0
    return out


def _folded(parts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (pairs, weights), pairs in either order, with the smaller token first, and of none with token 0."""
    if size * size <= DENSE:
        total = np.zeros(size * size)
        for pairs, weights in parts:
            total += np.bincount(pairs, weights, size * size)
        total = total.reshape(size, size)
        total[0] = total[:, 0] = 0
        total = (np.triu(total) + np.tril(total, -1).T).ravel()
        found = np.flatnonzero(total)
        return found, total[found]
    out = [(np.zeros(0, np.int64), np.zeros(0))]
    for pairs, weights in parts:
        a, b = np.divmod(pairs, size)
        real = (a > 0) & (b > 0)
        out.append(_summed((np.minimum(a, b) * size + np.maximum(a, b))[real], weights[real], size))
    return _summed(*(np.concatenate(x) for x in zip(*out, strict=True)), size)


def _summed(pairs: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    if size * size <= DENSE:
        total = np.bincount(pairs, weights, size * size)
        found = np.flatnonzero(total)
        return found, total[found]
    found, at = np.unique(pairs, return_inverse=True)
    total = np.bincount(at, weights, len(found))
    return found[total != 0], total[total != 0]


def _blocks(batches, slots: int):
    for batch in batches:
        for row in range(batch.num_rows):
            n, sizes, tokens, between = (np.frombuffer(column[row].as_buffer(), kind) for column, kind in zip(batch.columns, ("<i8", "<i4", "<i4", "<i4"), strict=True))
            yield _Block(tokens.reshape(slots, -1).copy(), between.copy(), sizes, n)


def _table(n: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, between: np.ndarray) -> pa.RecordBatch:
    """A row of SEQUENCES; tokens are slots x states."""
    parts = [np.ascontiguousarray(x, kind).tobytes() for x, kind in ((n, "<i8"), (sizes, "<i4"), (tokens, "<i4"), (between, "<i4"))]
    return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], names=["n", "sizes", "tokens", "between"])


def _first_states(vocab: Vocabulary):
    """Tokens of the atoms from code tuples."""
    atoms = atom_tokens(vocab)

    def run(batches):
        for batch in batches:
            ends = batch["feats"].value_lengths().to_numpy(zero_copy_only=False).cumsum()
            row = 0
            while row < batch.num_rows:
                begun = ends[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(ends, begun + STATES, "right")))
                part = batch.slice(row, end - row)
                tokens = atoms(part["feats"].flatten())
                yield _table(part["n"].to_numpy(), np.diff(ends[row:end], prepend=begun), tokens.T, np.zeros(len(tokens), np.int32))
                row = end

    return run


def _rewritten(rules, cross: bool, slots: int):
    def run(batches):
        for block in _blocks(batches, slots):
            for rule in rules:
                block.merge(*rule, cross)
            yield _table(block.n, np.bincount(block.seq, minlength=len(block.n)), block.tokens, block.between)

    return run


def _changes(rules, plan, cross: bool, barred: frozenset, first: int, slots: int, size: int, scale: int):
    """What the merges of plan change, in this order; step first counts from there. Without a plan: all masses, as step 0."""
    out = np.zeros(size, bool)
    out[sorted(barred)] = True
    out = out if barred else None

    def run(batches):
        found: dict = defaultdict(list)  # by step, pairs and values
        made: dict = defaultdict(Counter)
        held = 0

        def table():
            rows = []
            for step, parts in found.items():
                pairs, values = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)), size)
                rows.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), step), pa.int32()), pa.array(pairs // size, pa.int32()), pa.array(pairs % size, pa.int32()), pa.array(values, pa.float64()), pa.nulls(len(pairs), pa.string())], names=NAMES))
            for step, counts in made.items():
                rows.append(pa.RecordBatch.from_arrays([pa.array([step] * len(counts), pa.int32()), *[pa.array([-1] * len(counts), pa.int32())] * 2, pa.array(list(counts.values()), pa.float64()), pa.array(list(counts), pa.string())], names=NAMES))
            found.clear()
            made.clear()
            return rows

        for block in _blocks(batches, slots):
            for rule in rules:
                block.merge(*rule, cross)
            if not plan:
                found[0].append(block.masses(size, scale, cross, out))
                held += len(found[0][-1][0])
            for step, rule in enumerate(plan, first):
                seen: list = []
                look = lambda b, flags: seen.append(b.masses(size, scale, cross, out, flags))  # noqa: B023, E731
                counts = block.merge(*rule, cross, look, look)
                if counts is not None:
                    (old, minus), (new, plus) = seen
                    found[step].append((np.concatenate([old, new]), np.concatenate([-minus, plus])))
                    held += len(old) + len(new)
                    made[step].update(counts)
            if held > HELD:
                yield from table()
                held = 0
        yield from table()

    return run


class TableTrainer:
    """seqs: feats, the code tuples of a sequence's items (array of arrays). Rules and log are those of ``vocabulary.Trainer`` on
    the same corpus. guide: (left, right, priority) of merges that are known or to be checked, in order."""

    def __init__(self, seqs: DataFrame, cross: bool = True, allowed_slots: set[int] | None = None, ahead: int = AHEAD):
        spark = seqs.sparkSession
        self.spark, self.cross, self.slots, self.most = spark, cross, allowed_slots, ahead
        corpus = kept(seqs.where("size(feats) > 0").groupBy("feats").agg(F.count(F.lit(1)).alias("n")), "corpus")
        # slots x codes is bounded by the code books
        atoms = corpus.select(F.explode("feats").alias("f")).select(F.posexplode("f").alias("slot", "code")).distinct().orderBy("slot", "code").collect()
        self.vocab = Vocabulary([(r["slot"], r["code"]) for r in atoms])
        self.width = max(1, self.vocab.slots)
        # masses are whole numbers times this, so that sums are exact in any order; for very wide states they are not
        self.scale = math.lcm(*range(1, self.width + 1)) ** 2
        self.scale = self.scale if self.scale <= 10**9 else 1
        self.sequences = kept(corpus.mapInArrow(_first_states(self.vocab), SEQUENCES), "sequences")
        self.n_sequences, self.n_rows = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        discarded(corpus)
        self.pending: list[tuple[int, int, int]] = []
        self.rounds = [self._written([])]
        self.base, self.since = self.rounds[0].select("step", "a", "b", "value"), 1  # rounds from here on are not in base
        self.held = [0]  # by round, the last step that holds
        self.steps: list[tuple[int, int, float]] = []
        self.rows, self.now = self._top(0), 0  # and which of their masses are the present ones

    def _written(self, merges: list[tuple[int, int, int]], done: int = 0) -> DataFrame:
        # a token made of allowed ones is allowed, and no others are merged
        size = len(self.vocab) + len(merges)
        changes = self.sequences.mapInArrow(_changes(self.pending, merges, self.cross, self._barred(), done + 1, self.width, size, self.scale), CHANGES)
        return kept(changes.groupBy("step", "a", "b", "what").agg(F.sum("value").alias("value")).select(*NAMES), "changes")

    def _barred(self) -> frozenset:
        if self.slots is None:
            return frozenset()
        return frozenset(t for t in range(1, len(self.vocab)) if not {s for s, _ in self.vocab.parts(t)} <= self.slots)

    def _increments(self, guessed: int = 0) -> DataFrame:
        """step, a, b, value of all that holds, and of the last round also what is guessed."""
        out = self.base
        for k in range(self.since, len(self.rounds)):
            last = self.held[k] if k < len(self.held) else len(self.steps) + guessed
            out = out.unionByName(self.rounds[k].where((F.col("step") <= last) & F.col("what").isNull()).select("step", "a", "b", "value"))
        return out

    def _top(self, guessed: int) -> list[Row]:
        """a, b and at (masses after 0, 1, ... of the guessed merges) of the pairs that are largest at any of these."""
        done = len(self.steps)
        after = [F.coalesce(F.round(F.sum(F.when(F.col("step") <= done + j, F.col("value"))) / self.scale, 9), F.lit(0.0)) for j in range(guessed + 1)]
        totals = self._increments(guessed).groupBy("a", "b").agg(F.array(*after).alias("at"))
        most = F.array_max("at")
        return totals.withColumn("most", most).where("most > 0").orderBy(F.desc("most"), "a", "b").limit(CANDIDATES).collect()

    @staticmethod
    def _best(rows: list[Row], j: int) -> Row | None:
        """The pair of largest mass after j merges; None if it may be one that is not among these rows."""
        best = min(rows, key=lambda r: (-r["at"][j], r["a"], r["b"]), default=None)
        sure = best is not None and best["at"][j] > 0 and (len(rows) < CANDIDATES or best["at"][j] > rows[-1]["most"])
        return best if sure else None

    def _guess(self, first: Row, j: int, most: int) -> list[tuple[int, int]]:
        plan, taken = [(first["a"], first["b"])], {first["a"], first["b"]}
        for r in sorted(self.rows, key=lambda r: (-r["at"][j], r["a"], r["b"])):
            if len(plan) == most or r["at"][j] <= 0:
                break
            if not taken & {r["a"], r["b"]}:
                plan.append((r["a"], r["b"]))
                taken |= {r["a"], r["b"]}
        return plan

    def _round(self, plan: list[tuple[int, int]]) -> None:
        """Write what the merges of plan change."""
        n = len(self.vocab)
        self.rounds.append(self._written([(a, b, n + k) for k, (a, b) in enumerate(plan)], len(self.steps)))

    def train(self, size: int, guide: list[tuple[int, int, float]] | None = None) -> Vocabulary:
        """Merge until the vocabulary has this size or no pair is left. With a guide, its merges are the guesses, and one that
        is not the next merge, or not of its mass, is an error that names the step."""
        guide, ahead = list(guide or []), 4
        while len(self.vocab) < size:
            first = self._best(self.rows, self.now)
            if first is None:
                self.rows, self.now = self._top(0), 0
                first = next(iter(sorted(self.rows, key=lambda r: (-r["at"][0], r["a"], r["b"]))), None)
                if first is None:
                    break
            done, left = len(self.steps), size - len(self.vocab)
            known = guide[done : done + min(self.most, left)]
            plan = [(a, b) for a, b, _ in known] or self._guess(first, self.now, min(ahead, left))
            if plan[0] != (first["a"], first["b"]):
                raise ValueError(f"step {done + 1} merges {plan[0]}, where {first['a'], first['b']} is the next pair")
            self._round(plan)
            mass = [first["at"][self.now]]
            self.rows = self._top(len(plan))
            while len(mass) < len(plan):
                best = self._best(self.rows, len(mass))
                if best is None or (best["a"], best["b"]) != plan[len(mass)]:
                    if best is not None and known:
                        raise ValueError(f"step {done + len(mass) + 1} merges {plan[len(mass)]}, where {best['a'], best['b']} is the next pair")
                    break
                mass.append(best["at"][len(mass)])
            for k, (p, w) in enumerate(zip(plan, mass, strict=False)):
                if known and abs(known[k][2] - w) > 1e-6 * max(1.0, w):
                    raise ValueError(f"step {done + k + 1} has the priority {known[k][2]}, where the mass is {w}")
                self.pending.append((*p, self.vocab.add(*p, w)))
                self.steps.append((*p, w))
            self.held.append(len(self.steps))
            self.now, ahead = len(mass), min(self.most, max(4, 2 * len(mass)))
            self._tidy()
        return self.vocab

    def _tidy(self) -> None:
        if len(self.pending) >= REWRITE:
            old = self.sequences
            self.sequences = kept(old.mapInArrow(_rewritten(self.pending, self.cross, self.width), SEQUENCES), "sequences")
            discarded(old)
            self.pending = []
        if len(self.rounds) - self.since >= COMPACT:
            old = self.base
            summed = self._increments().groupBy("a", "b").agg(F.sum("value").alias("value")).where("abs(value) > 1e-10")
            self.base = kept(summed.select(F.lit(0).alias("step"), "a", "b", "value"), "masses")
            self.since = len(self.rounds)
            discarded(old)

    def log(self) -> list[dict]:
        """A record for each merge; one query over what all rounds have written."""
        rows = None
        for k, last in enumerate(self.held[1:], 1):
            one = self.rounds[k].where(F.col("step") <= last)
            rows = one if rows is None else rows.unionByName(one)
        counts: dict = defaultdict(Counter)
        if rows is not None:
            pairs = F.count_if(F.col("what").isNull() & (F.col("value") != 0))
            # a few rows for each rule
            for r in rows.groupBy("step", F.coalesce("what", F.lit("")).alias("what")).agg(F.sum("value").alias("v"), pairs.alias("p")).collect():
                counts[r["step"]][r["what"]] = r["p"] if r["what"] == "" else int(r["v"])
        out, n = [], len(self.vocab.atoms)
        for step, (a, b, w) in enumerate(self.steps, 1):
            kinds = {k: v for k, v in counts[step].items() if k not in ("", "sequences")}
            slots = sorted({s for s, _ in self.vocab.parts(n + step - 1)})
            out.append({"event": "merge", "step": step, "new_token": n + step - 1, "left": a, "right": b, "priority": w, "affected_sequences": counts[step]["sequences"], "merge_types": kinds, "slots": slots, "pair_updates": counts[step][""]})
        return out

    def close(self) -> None:
        """Delete the tables."""
        discarded(self.sequences, self.base, *self.rounds)


def train_on_tables(seqs: DataFrame, size: int, **options) -> tuple[Vocabulary, list[dict]]:
    trainer = TableTrainer(seqs, **options)
    vocab, log = trainer.train(size), trainer.log()
    trainer.close()
    return vocab, log


def _contents(table: DataFrame) -> Row:
    """Number and two sums of hashes of the rows, whatever their order."""
    row = F.xxhash64(*table.columns)
    return table.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(row, F.lit(1)))).first()


def trained_once(seqs: DataFrame, size: int, inputs: list[DataFrame] | None = None, **options) -> tuple[Vocabulary, DataFrame]:
    """Vocabulary and log of ``train_on_tables`` as tables in the session's shared folder, under a name made of the contents of
    seqs and the options, so that the same corpus is trained on once. inputs: tables whose rows alone make seqs; the name is of
    their contents then, and seqs are not made where the training is there."""
    spark = seqs.sparkSession
    found = [tuple(_contents(x)) for x in inputs or [seqs.select("feats")]]
    digest = hashlib.sha256(repr((found, size, sorted(options.items()))).encode()).hexdigest()[:24]
    path = named(spark, f"vocabulary-{digest}")
    if not exists(spark, f"{path}/log/_SUCCESS"):
        vocab, log = train_on_tables(seqs, size, **options)
        vocabulary_table(spark, vocab).write.mode("overwrite").parquet(f"{path}/tokens")
        rows = [tuple(r[c.split()[0]] for c in LOG.split(", ")) for r in log]
        spark.createDataFrame(rows, LOG).write.mode("overwrite").parquet(f"{path}/log")
    return from_table(spark.read.parquet(f"{path}/tokens")), spark.read.schema(LOG).parquet(f"{path}/log")


def replayed(seqs: DataFrame, log: list[dict], size: int | None = None, **options) -> tuple[Vocabulary, list[dict]]:
    """Make the merges of a stored log on the corpus again, each checked to be the next one and of the stated mass (an error names the
    first step that is not), then go on to a size. So a training that was cut off goes on from its log."""
    guide = [(r["left"], r["right"], r["priority"]) for r in sorted(log, key=lambda r: r["step"])]
    trainer = TableTrainer(seqs, **options)
    end = len(trainer.vocab) + len(guide)
    trainer.train(end, guide)
    if len(trainer.steps) < len(guide):
        raise ValueError(f"step {len(trainer.steps) + 1} merges {guide[len(trainer.steps)][:2]}, where no pair is left")
    if size is not None and size > end:
        trainer.train(size)
    vocab, new = trainer.vocab, trainer.log()
    trainer.close()
    return vocab, new
