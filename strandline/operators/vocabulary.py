"""The merge vocabulary: initial tokens, pair statistics, training, encoding and decoding.

What is relational runs as DataFrames: the initial vocabulary, the corpus of tokens, the pair masses, and
encoding of many sequences in Arrow batches with the rules sent along once. Training on tables is in ``training``; ``Trainer`` is
the form for a corpus that fits one process, which also says at each step what kinds of candidates there were."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAD = 0


# -- relational parts ------------------------------------------------------------------------------


def initial_vocabulary(items: DataFrame, feats: str = "feats") -> DataFrame:
    """(token, slot, code): token 0 is the pad, then slot by slot in ascending code."""
    atoms = items.select(F.posexplode(feats).alias("slot", "code")).distinct()
    # slots x codes is bounded by the code books, a few thousand rows
    return atoms.withColumn("token", F.row_number().over(Window.orderBy("slot", "code")).cast("int")).select("token", "slot", "code")


def token_states(seqs: DataFrame, items: DataFrame, vocab: DataFrame, key: str, seq: str = "seq", item: str = "item", feats: str = "feats") -> DataFrame:
    """(key, pos, state): every item of a sequence as the array of its atoms' tokens, in slot order."""
    atoms = items.select(item, F.posexplode(feats).alias("slot", "code")).join(vocab, ["slot", "code"])
    states = atoms.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("slot", "token"))).alias("_s"))
    states = states.select(item, F.transform("_s", lambda x: x["token"]).alias("state"))
    return seqs.select(key, F.posexplode(seq).alias("pos", item)).join(states, item).select(key, "pos", "state")


def pair_masses(states: DataFrame, key: str, cross: bool = True) -> DataFrame:
    """(key, a, b, mass): a <= b. Inside a state of M tokens a pair weighs 2 / M; between neighbouring
    states of M1 and M2 tokens it weighs 1 / (M1 * M2).

    Pairs are made by array functions inside a row, and neighbours come from lead(), so there is no self join."""
    here, ahead = F.col("state"), F.col("next")
    inside = F.flatten(
        F.transform(here, lambda x, i: F.transform(F.slice(here, i + 2, F.size(here)), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (2.0 / F.size(here)).alias("w"))))
    )
    between = F.flatten(
        F.transform(here, lambda x: F.transform(ahead, lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (1.0 / (F.size(here) * F.size(ahead))).alias("w"))))
    )
    rows = states.withColumn("next", F.lead("state").over(Window.partitionBy(key).orderBy("pos")))
    pairs = F.when(F.col("next").isNotNull(), F.concat(inside, between)).otherwise(inside) if cross else inside
    return rows.select(key, F.inline(pairs)).groupBy(key, "a", "b").agg(F.sum("w").alias("mass"))


def total_masses(masses: DataFrame, key: str) -> DataFrame:
    """(a, b, mass, n_sequences) over all sequences."""
    # masses has one row per key and pair
    return masses.groupBy("a", "b").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("n_sequences"))


def best_pair(totals: DataFrame) -> DataFrame:
    """The next merge: the largest mass, ties to the smallest pair."""
    return totals.orderBy(F.desc("mass"), "a", "b").limit(1)


def mass_difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """(a, b, change) over the union of pairs, where it is not zero."""
    both = new.select("a", "b", F.col("mass").alias("_n")).join(old.select("a", "b", F.col("mass").alias("_o")), ["a", "b"], "full_outer")
    return both.select("a", "b", (F.coalesce("_n", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0))).alias("change")).where("change != 0")


def atoms_of(vocab: DataFrame) -> DataFrame:
    """(token, slot, code): the atoms of every token, by a recursive query over the rules.

    vocab: (token, left, right, slot, code); slot is -1 for merged tokens."""
    spark = vocab.sparkSession
    vocab.createOrReplaceTempView("_strandline_vocab")
    return spark.sql(
        """
        WITH RECURSIVE parts(token, part) AS (
          SELECT token, token FROM _strandline_vocab
          UNION ALL
          SELECT p.token, x.part FROM parts p JOIN
            (SELECT token, left AS part FROM _strandline_vocab WHERE slot < 0
             UNION ALL SELECT token, right AS part FROM _strandline_vocab WHERE slot < 0) x ON x.token = p.part
        )
        SELECT p.token, v.slot, v.code FROM parts p JOIN _strandline_vocab v ON v.token = p.part WHERE v.slot >= 0
        """
    )


def decode_states(tokens: DataFrame, atoms: DataFrame, key: str, slots: int) -> DataFrame:
    """(key, codes): null codes unless the tokens together have every slot exactly once.

    tokens: (key, token), one row per token. A token that is not in atoms (the pad, or out of range)
    makes the state invalid."""
    joined = tokens.join(atoms, "token", "left")
    grouped = joined.groupBy(key).agg(
        F.count_if(F.col("slot").isNull()).alias("bad"),
        F.count("slot").alias("n"),
        F.count_distinct("slot").alias("d"),
        F.array_sort(F.collect_list(F.struct("slot", "code"))).alias("s"),
    )
    good = (F.col("bad") == 0) & (F.col("n") == slots) & (F.col("d") == slots)
    return grouped.select(key, F.when(good, F.transform("s", lambda x: x["code"])).alias("codes"))


def provenance(left, right):
    """How the sources of two operands relate."""
    both = F.array_union(left, right)
    apart = (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)
    return F.when(apart, "cross_source").when(F.size(both) > 1, "mixed_or_shared_source").otherwise("single_source")


def atom_sources(items: DataFrame, sources: DataFrame, vocab: DataFrame, item: str = "item", feats: str = "feats") -> DataFrame:
    """(token, sources): the sources of the items an atom occurs in."""
    atoms = items.select(item, F.posexplode(feats).alias("slot", "code")).join(vocab, ["slot", "code"])
    flat = atoms.select(item, "token").join(sources.select(item, F.explode("sources").alias("source")), item)
    return flat.groupBy("token").agg(F.array_sort(F.collect_set("source")).alias("sources"))


# -- sequences with context slots ------------------------------------------------------------------


class Chain:
    """States in order with a slot between neighbours that holds the token of a merge across them."""

    __slots__ = ("between", "moved", "states")

    def __init__(self, states, between=None):
        self.states = [list(s) for s in states]
        self.between = [None] * (len(self.states) - 1) if between is None else list(between)
        self.moved = False  # whether the last merge emptied a state, after which places are others

    def groups(self) -> list[list[int]]:
        """Tokens state by state, each slot that holds a token as a group of its own."""
        out = []
        for k, s in enumerate(self.states):
            out.append(list(s))
            if k < len(self.between) and self.between[k] is not None:
                out.append([self.between[k]])
        return out

    def tokens(self) -> list[int]:
        return [t for g in self.groups() for t in g]

    def tidy(self) -> None:
        """A state that ran empty takes the token in front of it; an empty state with an empty slot
        behind it disappears. Repeated until nothing changes."""
        self.moved = not all(self.states)
        again = self.moved
        while again:
            again = False
            for k in range(1, len(self.states)):
                if not self.states[k] and self.between[k - 1] is not None:
                    self.states[k], self.between[k - 1] = [self.between[k - 1]], None
                    again = True
            k = 0
            while k < len(self.between):
                if not self.states[k] and self.between[k] is None:
                    del self.states[k], self.between[k]
                    again = True
                else:
                    k += 1

    def apply(self, low: int, high: int, token: int, cross: bool = True, places: list[int] | None = None) -> Counter:
        """Merge the pair wherever it occurs, from left to right; returns counts by kind of merge. places, if known,
        are those of the pair."""
        done: Counter = Counter()
        for k in self.places(low, high, cross) if places is None else places:
            s = self.states[k]
            if low != high and low in s and high in s:
                self.states[k] = [token] + [t for t in s if t not in (low, high)]
                done["same_action"] += 1
            if k == len(self.between) or not cross:
                continue
            if self.between[k] is not None:
                done["action_context"] += self._with_slot(k, k, low, high, token)
                done["action_context"] += self._with_slot(k + 1, k, low, high, token)
            else:
                done["adjacent_actions"] += self._across(k, low, high, token)
        self.tidy()
        return +done

    def _with_slot(self, state: int, slot: int, low: int, high: int, token: int) -> int:
        held = self.between[slot]
        if held not in (low, high):
            return 0
        want = high if held == low else low
        if want not in self.states[state]:
            return 0
        self.states[state] = [t for t in self.states[state] if t != want]
        self.between[slot] = token
        return 1

    def _across(self, k: int, low: int, high: int, token: int) -> int:
        a, b = self.states[k], self.states[k + 1]
        for x, y in ((low, high), (high, low)):
            if x in a and y in b:
                self.states[k] = [t for t in a if t != x]
                self.states[k + 1] = [t for t in b if t != y]
                self.between[k] = token
                return 1
        return 0

    def neighbours(self, cross: bool = True):
        """Groups of tokens that may merge: (tokens, None) inside a state, (tokens, tokens) across."""
        for k, s in enumerate(self.states):
            yield s, None
            if k < len(self.between) and cross:
                if self.between[k] is not None:
                    yield s, [self.between[k]]
                    yield [self.between[k]], self.states[k + 1]
                else:
                    yield s, self.states[k + 1]

    def places(self, low: int, high: int, cross: bool = True) -> list[int]:
        """The states that a merge of the pair may change: those that hold both tokens, and two neighbours that hold one
        each, one of them perhaps in the slot between them. A merge makes no new place of its pair."""
        held = [(low in s) + 2 * (high in s) for s in self.states]
        out = {k for k, x in enumerate(held) if x == 3}
        if cross:
            for k, t in enumerate(self.between):
                x, y = held[k], held[k + 1]
                if t is None:
                    if x and y and (x | y) == 3:
                        out |= {k, k + 1}
                elif (t == low and (x | y) & 2) or (t == high and (x | y) & 1):
                    out |= {k, k + 1}
        return sorted(out)

    def around(self, places: list[int], cross: bool = True):
        """Of neighbours, the groups that have one of these states."""
        edges = set()
        for k in places:
            yield self.states[k], None
            edges |= {k - 1, k}
        if cross:
            for k in sorted(edges):
                if 0 <= k < len(self.between):
                    if self.between[k] is not None:
                        yield self.states[k], [self.between[k]]
                        yield [self.between[k]], self.states[k + 1]
                    else:
                        yield self.states[k], self.states[k + 1]

    def masses(self, allowed=None, cross: bool = True, places: list[int] | None = None) -> dict:
        """Masses of all pairs, or of the groups around some states."""
        out: dict = defaultdict(float)
        for a, b in self.neighbours(cross) if places is None else self.around(places, cross):
            x = a if allowed is None else [t for t in a if allowed(t)]
            if b is None:
                for i, t in enumerate(x):
                    for u in x[i + 1 :]:
                        out[min(t, u), max(t, u)] += 2 / len(x)
            else:
                y = b if allowed is None else [t for t in b if allowed(t)]
                for t in x:
                    for u in y:
                        out[min(t, u), max(t, u)] += 1 / (len(x) * len(y))
        return out


class Vocabulary:
    """Atoms and merge rules. token 0 is the pad; a merged token's operands have smaller ids."""

    def __init__(self, atoms: list[tuple[int, int]]):
        self.atoms = [None, *atoms]  # (slot, code) by token
        self.rules: list[tuple[int, int]] = []  # of token len(atoms) + k
        self.priority: list[float] = []
        self.index = {a: k for k, a in enumerate(self.atoms) if a is not None}
        self.rank: dict[tuple[int, int], int] = {}
        self.slots = 1 + max((s for s, _ in atoms), default=-1)
        self._parts: dict[int, tuple] = {}

    def __len__(self) -> int:
        return len(self.atoms) + len(self.rules)

    def add(self, low: int, high: int, priority: float) -> int:
        token = len(self)
        self.rules.append((low, high))
        self.priority.append(priority)
        self.rank[low, high] = token
        return token

    def truncated(self, size: int) -> Vocabulary:
        if not len(self.atoms) <= size <= len(self):
            raise ValueError("the size must lie between the atoms and the whole vocabulary")
        out = Vocabulary(self.atoms[1:])
        for rule, p in list(zip(self.rules, self.priority, strict=True))[: size - len(self.atoms)]:
            out.add(*rule, p)
        return out

    def weight(self, token: int) -> float:
        return self.priority[token - len(self.atoms)]

    def parts(self, token: int) -> tuple:
        """The atoms (slot, code) of a token."""
        if token not in self._parts:
            n = len(self.atoms)
            self._parts[token] = (self.atoms[token],) if token < n else self.parts(self.rules[token - n][0]) + self.parts(self.rules[token - n][1])
        return self._parts[token]

    def decode(self, tokens) -> list[int] | None:
        """Codes by slot; None on a pad, an unknown token, or a slot that is missing or repeated."""
        found: dict[int, int] = {}
        for t in tokens:
            if not 0 < t < len(self):
                return None
            for slot, code in self.parts(t):
                if slot in found:
                    return None
                found[slot] = code
        return [found[k] for k in range(self.slots)] if len(found) == self.slots else None

    def state(self, feats) -> list[int]:
        return [self.index[k, c] for k, c in enumerate(feats)]

    # -- encoding

    def encode_flat(self, tokens: list[int]) -> list[int]:
        """Pairwise merging of a flat list: the neighbouring pair of lowest rank first, leftmost on ties."""
        tokens = list(tokens)
        while True:
            best, at = None, -1
            for k in range(len(tokens) - 1):
                a, b = tokens[k], tokens[k + 1]
                r = self.rank.get((a, b) if a <= b else (b, a))
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return tokens
            tokens[at : at + 2] = [best]

    def encode_best(self, states, path: bool = False, groups: bool = False):
        """Best-first merging with context slots. The score of a merge is its priority over the sizes of
        what it joins; the first of equal scores in reading order wins. path: all stages as token lists; groups: the
        last stage state by state."""
        return _Encoder(self, states).run(path, groups)

    def merge_path(self, state) -> list[list[int]]:
        return self.encode_best([state], path=True)

    def greedy_length(self, state) -> int:
        return len(self.encode_best([state]))


class _Link:
    """A state in a chain of them, and the slot behind it."""

    __slots__ = ("age", "at", "behind", "front", "slot", "tokens")

    def __init__(self, at: int, tokens: list[int]):
        self.at, self.tokens, self.slot = at, tokens, None
        self.front: _Link | None = None
        self.behind: _Link | None = None
        self.age = [0, 0, 0]  # of the places IN, BEHIND and NEXT


class _Encoder:
    """One sequence that is being merged. Places of a link, in reading order: IN its state; BEHIND it, its state with its slot, or with
    the next state where the slot is empty; NEXT, the next state with the slot.

    A heap has the best candidate of every place. A merge touches a state or two, so only the places around them are looked at
    again; what the heap still holds of them is known by its age and passed over."""

    IN, BEHIND, NEXT = 0, 1, 2

    def __init__(self, vocab: Vocabulary, states):
        self.vocab = vocab
        self.heap: list = []
        links = [_Link(k, list(s)) for k, s in enumerate(states)]
        self.first = links[0] if links else None
        for x, y in zip(links, links[1:], strict=False):
            x.behind, y.front = y, x
        for x in links:
            self._look(x)

    def groups(self) -> list[list[int]]:
        out, x = [], self.first
        while x is not None:
            out.append(list(x.tokens))
            if x.slot is not None:
                out.append([x.slot])
            x = x.behind
        return out

    def tokens(self) -> list[int]:
        return [t for g in self.groups() for t in g]

    def _enter(self, x: _Link, place: int, a: list[int], b: list[int] | None = None) -> None:
        x.age[place] += 1
        best, how, rank, weight = 0.0, None, self.vocab.rank, self.vocab.weight
        for i, t in enumerate(a):
            for u in a[i + 1 :] if b is None else b:
                pair = (t, u) if t <= u else (u, t)
                token = rank.get(pair)
                if token is not None:
                    score = weight(token) * (2 / len(a) if b is None else 1 / (len(a) * len(b)))
                    if how is None or score > best:
                        best, how = score, (pair, token)
        if how is not None:
            heapq.heappush(self.heap, (-best, x.at, place, x.age[place], x, how))

    def _look(self, x: _Link) -> None:
        """Find the best candidates of all places of a link again."""
        self._enter(x, self.IN, x.tokens)
        if x.behind is not None and x.slot is not None:
            self._enter(x, self.BEHIND, x.tokens, [x.slot])
            self._enter(x, self.NEXT, x.behind.tokens, [x.slot])
        else:
            self._enter(x, self.BEHIND, x.tokens, x.behind.tokens if x.behind else [])
            x.age[self.NEXT] += 1

    def _drop(self, x: _Link) -> None:
        x.age = [a + 1 for a in x.age]
        x.behind.front = x.front
        if x.front is None:
            self.first = x.behind
        else:
            x.front.behind = x.behind

    def _tidy(self, around: list[_Link]) -> list[_Link]:
        """What ``Chain.tidy`` does, for some neighbouring links; those that are left."""
        again = not all(x.tokens for x in around)
        while again:
            again = False
            for x in around:
                if not x.tokens and x.front is not None and x.front.slot is not None:
                    x.tokens, x.front.slot = [x.front.slot], None
                    again = True
            for x in list(around):
                if not x.tokens and x.behind is not None and x.slot is None:
                    self._drop(x)
                    around.remove(x)
                    again = True
        return around

    def _merge(self, x: _Link, place: int, pair: tuple[int, int], token: int) -> None:
        low, high = pair
        if place == self.IN:
            x.tokens = [token] + [t for t in x.tokens if t not in pair]
        elif x.slot is None:
            y = x.behind
            t, u = pair if low in x.tokens and high in y.tokens else (high, low)
            x.tokens, y.tokens, x.slot = [v for v in x.tokens if v != t], [v for v in y.tokens if v != u], token
        else:
            y = x if place == self.BEHIND else x.behind
            want = high if x.slot == low else low
            y.tokens, x.slot = [v for v in y.tokens if v != want], token

    def run(self, path: bool, groups: bool):
        stages = [self.tokens()] if path else []
        while self.heap:
            _, _, place, age, x, how = heapq.heappop(self.heap)
            if x.age[place] != age:
                continue
            self._merge(x, place, *how)
            front, behind = x.front, x.behind
            near = [y for y in (front and front.front, front, x, behind, behind and behind.behind) if y is not None]
            for y in self._tidy(near):
                self._look(y)
            if path:
                stages.append(self.tokens())
        return stages if path else self.groups() if groups else self.tokens()


def choose_stage(path: list[list[int]], policy: str, draw: int = 0) -> list[int]:
    """raw: atoms; full: merged as far as it goes; middle; random: by a number drawn from a hash."""
    if policy == "raw":
        return path[0]
    if policy == "full":
        return path[-1]
    if policy == "middle":
        return path[(len(path) - 1) // 2]
    if policy == "random":
        return path[draw % len(path)]
    raise ValueError(f"unknown policy {policy}")


# -- training --------------------------------------------------------------------------------------


class Trainer:
    """Learns merge rules. corpus: (states, count) with states as lists of atom tokens.

    A pair's mass is kept up to date by recounting, in the sequences that hold it, what lies around its tokens; a heap with stale entries
    gives the largest mass, ties to the smallest pair. Training ends early when no pair is left."""

    def __init__(self, vocab: Vocabulary, corpus, cross: bool = True, allowed_slots: set[int] | None = None, groups: dict[str, set[int]] | None = None):
        """groups: slots by a name such as text or image; then every record says how many candidate pairs of each kind
        there were before the merge, and their mass. A kind is the names of both sides, in the order of groups; a token of several
        groups, or of none, is mixed."""
        self.vocab, self.cross, self.groups = vocab, cross, groups
        self._names: dict[int, str] = {}
        self.kind_count: Counter = Counter()
        self.kind_mass: dict = defaultdict(float)
        self.allowed = None if allowed_slots is None else (lambda t: {s for s, _ in vocab.parts(t)} <= allowed_slots)
        self.chains = [Chain(states) for states, _ in corpus]
        self.counts = [n for _, n in corpus]
        self.own: list[dict] = []
        self.total: dict = defaultdict(float)
        self.where: dict = defaultdict(set)
        for k, chain in enumerate(self.chains):
            m = chain.masses(self.allowed, cross)
            self.own.append(m)
            for pair, w in m.items():
                self.total[pair] += w * self.counts[k]
                self.where[pair].add(k)
        for pair, w in self.total.items():
            self._track(pair, 0.0, w)
        # rounded, so that equal masses are ties whatever the order in which they were summed
        self.heap = [(-round(w, 9), pair) for pair, w in self.total.items()]
        heapq.heapify(self.heap)
        self.log: list[dict] = []

    def _name(self, token: int) -> str:
        if token not in self._names:
            slots = {s for s, _ in self.vocab.parts(token)}
            self._names[token] = next((g for g, own in self.groups.items() if slots <= own), "mixed")
        return self._names[token]

    def kind(self, pair: tuple[int, int]) -> str:
        order = [*self.groups, "mixed"]
        return "_".join(sorted(map(self._name, pair), key=order.index))

    def _track(self, pair, before: float, after: float) -> None:
        """Keep the counts and masses of candidate kinds when a pair's mass changes; 0 is no candidate."""
        if self.groups is not None:
            k = self.kind(pair)
            self.kind_count[k] += (after > 1e-12) - (before > 1e-12)
            self.kind_mass[k] += after - before

    def step(self) -> dict | None:
        while self.heap:
            w, pair = heapq.heappop(self.heap)
            if -w > 1e-12 and round(self.total.get(pair, 0.0), 9) == -w:
                break
        else:
            return None
        seen = {} if self.groups is None else {
            "selected": self.kind(pair), "candidate_counts": dict(+self.kind_count),
            "candidate_masses": {k: self.kind_mass[k] for k, n in self.kind_count.items() if n > 0},
        }
        token = self.vocab.add(*pair, -w)
        touched, kinds, change = sorted(self.where[pair]), Counter(), set()
        for k in touched:
            chain, own, n = self.chains[k], self.own[k], self.counts[k]
            places = chain.places(*pair, self.cross)
            old = chain.masses(self.allowed, self.cross, places)
            kinds.update({kind: m * n for kind, m in chain.apply(*pair, token, self.cross, places).items()})
            if chain.moved:
                places, old = None, own
            new = chain.masses(self.allowed, self.cross, places)
            for p in new.keys() | old.keys():
                d = new.get(p, 0.0) - old.get(p, 0.0)
                if d:
                    left = own.get(p, 0.0) + d
                    if left < 1e-9:  # far below any share of a pair
                        own.pop(p, None)
                        self.where[p].discard(k)
                    else:
                        own[p] = left
                        self.where[p].add(k)
                    d *= n
                    before = self.total.get(p, 0.0)
                    self.total[p] += d
                    self._track(p, before, self.total[p])
                    change.add(p)
        for p in change:
            if abs(self.total[p]) < 1e-12:
                self.total.pop(p)
            else:
                heapq.heappush(self.heap, (-round(self.total[p], 9), p))
        n = len(self.vocab.atoms)
        record = {
            "event": "merge", "step": token - n + 1, "new_token": token, "left": pair[0], "right": pair[1], "priority": -w,
            "affected_sequences": sum(self.counts[k] for k in touched), "merge_types": dict(kinds),
            "slots": sorted({s for s, _ in self.vocab.parts(token)}), "pair_updates": len(change), **seen,
        }
        self.log.append(record)
        return record

    def train(self, size: int) -> Vocabulary:
        while len(self.vocab) < size and self.step():
            pass
        return self.vocab

    def records(self, interval: int = 1) -> list[dict]:
        """The log with a start and an end record, and of the merges every interval-th one and the last."""
        n = len(self.vocab.atoms)
        steps = [r for r in self.log if r["step"] % interval == 0 or r is self.log[-1]]
        start = {"event": "start", "atoms": n - 1, "sequences": len(self.chains), "interactions": sum(self.counts), "cross": self.cross}
        return [start, *steps, {"event": "end", "size": len(self.vocab), "steps": len(self.log), "candidates": len(self.total)}]


def encode_sequences(seqs: DataFrame, vocab: Vocabulary, key: str, mode: str = "none", scope: str = "sequence", seed: int = 2024) -> DataFrame:
    """(key, tokens) of every sequence of feats, in Arrow batches; the rules travel with the function.

    mode ``feature``: tokens of a state in random order, then flat merging over the whole list; ``none``:
    best-first with context slots, in many sequences at once; ``token``: the same, then the tokens of each state in random order, the states in
    theirs. Random orders depend on the seed and the key alone. scope ``item`` encodes each item by itself."""
    import random

    if mode not in ("feature", "none", "token") or scope not in ("sequence", "item"):
        raise ValueError("unknown mode or scope")

    def one(k, states):
        rng = random.Random(f"{seed}:{k}")
        if mode == "feature":
            flat = []
            for s in states:
                flat += rng.sample(s, len(s))
            return vocab.encode_flat(flat)
        if mode == "token":
            return [t for g in vocab.encode_best(states, groups=True) for t in rng.sample(g, len(g))]
        return vocab.encode_best(states)

    def run(batches):
        for pdf in batches:
            tokens = []
            for k, feats in zip(pdf[key], pdf["feats"], strict=True):
                states = [vocab.state(f) for f in feats]
                tokens.append(one(k, states) if scope == "sequence" else [t for s in states for t in one(k, [s])])
            yield pd.DataFrame({key: pdf[key], "tokens": tokens})

    kind = dict(seqs.dtypes)[key]
    if mode == "none":
        from strandline.operators.encoding import encoded

        return seqs.select(key, "feats").mapInArrow(encoded(vocab, key, scope == "item"), f"{key} {kind}, tokens array<int>")
    return seqs.select(key, "feats").mapInPandas(run, f"{key} {kind}, tokens array<int>")


def vocabulary_table(spark, vocab: Vocabulary) -> DataFrame:
    """(token, left, right, slot, code, priority): one row per token but the pad."""
    n = len(vocab.atoms)
    rows = [(t, 0, 0, *vocab.atoms[t], 0.0) for t in range(1, n)]
    rows += [(n + k, a, b, -1, -1, float(p)) for k, ((a, b), p) in enumerate(zip(vocab.rules, vocab.priority, strict=True))]
    return spark.createDataFrame(rows, "token int, left int, right int, slot int, code int, priority double")


def from_table(table: DataFrame, size: int | None = None) -> Vocabulary:
    rows = table.orderBy("token").collect()  # a vocabulary fits the driver by its nature
    vocab = Vocabulary([(r["slot"], r["code"]) for r in rows if r["slot"] >= 0])
    for r in rows:
        if r["slot"] < 0:
            vocab.add(r["left"], r["right"], r["priority"])
    return vocab if size is None else vocab.truncated(size)
