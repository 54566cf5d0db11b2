"""The merge vocabulary against a slow trainer that recounts everything at each step."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import merge_log as L
from strandline.operators import vocabulary as M


class Nodes:
    """A sequence as a list of nodes, states at even places and slots between, and the rules on it written out anew:
    the slow form that trainer and encoder are held against."""

    def __init__(self, states):
        self.nodes = []
        for s in states:
            self.nodes += [list(s), []]
        self.nodes.pop()

    def neighbours(self):
        """Places whose tokens may meet."""
        out = []
        for k in range(0, len(self.nodes), 2):
            out.append((k, k))
            if k + 2 < len(self.nodes):
                out += [(k, k + 1), (k + 1, k + 2)] if self.nodes[k + 1] else [(k, k + 2)]
        return out

    def pairs(self, ok=lambda t: True, cross=True):
        """(pair, share) of every two tokens that may meet, in reading order."""
        for i, j in self.neighbours():
            a, b = ([t for t in self.nodes[x] if ok(t)] for x in (i, j))
            if i == j:
                yield from (((min(x, y), max(x, y)), 2 / len(a), i, j) for n, x in enumerate(a) for y in a[n + 1 :])
            elif cross:
                yield from (((min(x, y), max(x, y)), 1 / (len(a) * len(b)), i, j) for x in a for y in b)

    def join(self, pair, new, i, j):
        """Merge a pair at two places: inside a state the new token leads it, across it goes into the slot."""
        x, y = pair
        if i == j:
            self.nodes[i] = [new, *(t for t in self.nodes[i] if t not in pair)]
            return
        if not (x in self.nodes[i] and y in self.nodes[j]):
            x, y = y, x
        self.nodes[i] = [t for t in self.nodes[i] if t != x]
        self.nodes[j] = [t for t in self.nodes[j] if t != y]
        self.nodes[i if i % 2 else j if j % 2 else i + 1] = [new]

    def collapse(self):
        while True:
            for k in range(2, len(self.nodes), 2):
                if not self.nodes[k] and self.nodes[k - 1]:
                    self.nodes[k], self.nodes[k - 1] = self.nodes[k - 1], []
                    break
            else:
                for k in range(0, len(self.nodes) - 1, 2):
                    if not self.nodes[k] and not self.nodes[k + 1]:
                        del self.nodes[k : k + 2]
                        break
                else:
                    return

    def merge_all(self, pair, new, cross=True):
        """A rule of training: from left to right, inside a state and then towards the next one."""
        for k in range(0, len(self.nodes), 2):
            if pair[0] != pair[1] and set(pair) <= set(self.nodes[k]):
                self.join(pair, new, k, k)
            if not cross or k + 2 >= len(self.nodes):
                continue
            places = [(k, k + 1), (k + 1, k + 2)] if self.nodes[k + 1] else [(k, k + 2)]
            for i, j in places:
                if any(x in self.nodes[i] and y in self.nodes[j] for x, y in (pair, pair[::-1])):
                    self.join(pair, new, i, j)
        self.collapse()

    def tokens(self):
        return [t for n in self.nodes for t in n]


def slow_train(vocab, corpus, size, cross=True, allowed=None):
    chains = [(Nodes(states), n) for states, n in corpus]
    ok = (lambda t: True) if allowed is None else (lambda t: {s for s, _ in vocab.parts(t)} <= allowed)
    while len(vocab) < size:
        total = {}
        for c, n in chains:
            for pair, share, *_ in c.pairs(ok, cross):
                total[pair] = total.get(pair, 0.0) + share * n
        if not total:
            break
        best = min(total, key=lambda p: (-round(total[p], 9), p))
        token = vocab.add(*best, total[best])
        for c, _ in chains:
            c.merge_all(best, token, cross)
    return vocab


def slow_encode(vocab, states):
    c = Nodes(states)
    while True:
        best = None
        for pair, share, i, j in c.pairs():
            token = vocab.rank.get(pair)
            if token is not None and (best is None or vocab.weight(token) * share > best[0]):
                best = vocab.weight(token) * share, pair, token, i, j
        if best is None:
            return c
        c.join(*best[1:])
        c.collapse()


def random_corpus(seed, items=6, slots=3, codes=3, n=8):
    rng = random.Random(seed)
    atoms = [(s, c) for s in range(slots) for c in range(codes)]
    vocab = M.Vocabulary(atoms)
    corpus = []
    for _ in range(n):
        feats = [[rng.randrange(codes) for _ in range(slots)] for _ in range(rng.randint(1, items))]
        corpus.append(([vocab.state(f) for f in feats], rng.randint(1, 3)))
    return atoms, corpus


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("cross", [True, False])
def test_fast_trainer_equals_recount(seed, cross):
    atoms, corpus = random_corpus(seed)
    fast = M.Trainer(M.Vocabulary(atoms), corpus, cross=cross).train(24)
    slow = slow_train(M.Vocabulary(atoms), corpus, 24, cross)
    assert fast.rules == slow.rules
    for a, b in zip(fast.priority, slow.priority, strict=True):
        assert a == pytest.approx(b)


def test_masses_of_one_item():
    vocab = M.Vocabulary([(0, 3), (1, 1), (2, 4), (3, 1)])
    masses = M.Chain([vocab.state([3, 1, 4, 1])]).masses()
    assert masses == {(a, b): 0.5 for a, b in itertools.combinations(range(1, 5), 2)}


@pytest.mark.parametrize("seed", range(8))
def test_best_first_encoding_equals_the_slow_form(seed):
    atoms, corpus = random_corpus(seed, items=7, codes=2, n=12)
    vocab = M.Trainer(M.Vocabulary(atoms), corpus).train(30)
    for states, _ in corpus:
        slow = slow_encode(vocab, states)
        assert vocab.encode_best(states) == slow.tokens()
        assert [g for g in vocab.encode_best(states, groups=True) if g] == [n for n in slow.nodes if n]


def test_token_mode_shuffles_inside_states(spark):
    rng = random.Random(3)
    rows = [(k, [[rng.randrange(4), rng.randrange(4), rng.randrange(4)] for _ in range(rng.randint(1, 6))]) for k in range(30)]
    vocab = M.Vocabulary([(s, c) for s in range(3) for c in range(4)])
    df = spark.createDataFrame(rows, "k long, feats array<array<int>>")
    got = {r["k"]: r["tokens"] for r in M.encode_sequences(df, vocab, "k", "token").collect()}
    moved = 0
    for k, feats in rows:  # without rules every state keeps its three tokens
        for j, f in enumerate(feats):
            own = got[k][3 * j : 3 * j + 3]
            assert sorted(own) == vocab.state(f)
            moved += own != vocab.state(f)
    assert moved > 20


@pytest.mark.parametrize("cross", [True, False])
def test_candidates_by_kind_equal_a_recount(cross):
    atoms, corpus = random_corpus(5, slots=5, n=10)
    groups = {"text": {0, 1}, "image": {2, 3}}
    vocab = M.Vocabulary(atoms)
    trainer = M.Trainer(vocab, corpus, cross=cross, groups=groups)
    chains = [(Nodes(states), n) for states, n in corpus]
    name = lambda t: next((g for g, own in groups.items() if {s for s, _ in vocab.parts(t)} <= own), "mixed")
    for _ in range(20):
        total = {}
        for c, n in chains:
            for pair, share, *_ in c.pairs(cross=cross):
                total[pair] = total.get(pair, 0.0) + share * n
        count, mass = {}, {}
        for pair, w in total.items():
            k = "_".join(sorted(map(name, pair), key=["text", "image", "mixed"].index))
            count[k], mass[k] = count.get(k, 0) + 1, mass.get(k, 0.0) + w
        r = trainer.step()
        assert r["candidate_counts"] == count and r["candidate_masses"] == pytest.approx(mass) and r["selected"] in count
        for c, _ in chains:
            c.merge_all((r["left"], r["right"]), r["new_token"], cross)
    records = trainer.records(interval=6)
    assert [x["event"] for x in records] == ["start"] + ["merge"] * 4 + ["end"] and [x["step"] for x in records[1:-1]] == [6, 12, 18, 20]
    assert records[-1]["steps"] == 20 and records[0]["atoms"] == len(atoms)


def test_training_records_feed_the_exposure(spark, tmp_path):
    from strandline.sources import artefacts, records

    atoms, corpus = random_corpus(6, slots=4, n=10)
    trainer = M.Trainer(M.Vocabulary(atoms), corpus, cross=False, groups={"text": {0, 1}, "image": {2, 3}})
    trainer.train(len(atoms) + 12)
    lines = spark.createDataFrame([(json.dumps(r),) for r in trainer.records()], "value string")
    lines.coalesce(1).write.text(f"{tmp_path}/log")
    got, bad = records.merge_log(spark, f"{tmp_path}/log")
    assert got.where("event = 'merge'").count() == 11 and bad.first()["n_malformed"] == 0
    rows = [(r["selected"], {k: float(v) for k, v in r["candidate_counts"].items()}, r["candidate_masses"]) for r in trainer.log]
    out = L.exposure(spark.createDataFrame(rows, "selected string, counts map<string,double>, masses map<string,double>"))
    selected = {r["kind"]: r["selected"] for r in out.collect()}
    assert all(selected[k] == sum(r[0] == k for r in rows) for k in selected)
    artefacts.save_json(spark.createDataFrame([(r["step"], r["priority"]) for r in trainer.log], "step int, priority double"), f"{tmp_path}/steps", order=["step"])
    with open(f"{tmp_path}/log/extra.txt", "w") as f:
        f.write("{broken\n")
    assert records.merge_log(spark, f"{tmp_path}/log")[1].first()["n_malformed"] == 1
    assert [r["step"] for r in spark.read.json(f"{tmp_path}/steps").orderBy("step").collect()] == list(range(1, 12))


def test_greedy_length_is_that_of_the_encoding():
    atoms, corpus = random_corpus(9)
    vocab = M.Trainer(M.Vocabulary(atoms), corpus, cross=False).train(20)
    for states, _ in corpus:
        for s in states:
            assert vocab.greedy_length(s) == len(slow_encode(vocab, [s]).tokens()) == len(vocab.merge_path(s)[-1])


def test_allowed_slots_bound_the_merges():
    vocab = M.Vocabulary([(0, 10), (1, 20), (2, 30)])
    M.Trainer(vocab, [([vocab.state([10, 20, 30])], 1)], allowed_slots={0, 1}).train(10)
    assert [sorted(s for s, _ in vocab.parts(t)) for t in range(4, len(vocab))] == [[0, 1]]


def test_item_local_training_merges_inside_items_only():
    vocab = M.Vocabulary([(0, 10), (0, 11), (1, 20), (1, 21)])
    t = M.Trainer(vocab, [([vocab.state([10, 20]), vocab.state([11, 21])], 1)], cross=False)
    assert t.step()["merge_types"] == {"same_action": 1}


@pytest.mark.parametrize("seed", range(4))
def test_encoding_keeps_the_atoms(seed):
    atoms, corpus = random_corpus(seed)
    vocab = M.Trainer(M.Vocabulary(atoms), corpus).train(24)
    for states, _ in corpus:
        want = sorted(itertools.chain.from_iterable(vocab.parts(t) for s in states for t in s))
        for tokens in (vocab.encode_best(states), vocab.encode_flat([t for s in states for t in s])):
            assert sorted(itertools.chain.from_iterable(vocab.parts(t) for t in tokens)) == want


def test_merge_path_shrinks_by_one_and_decodes():
    feats = {"p": [7, 1, 5], "q": [7, 2, 6], "r": [8, 2, 5], "s": [8, 1, 6], "t": [9, 2, 6]}
    atoms = sorted({(k, c) for f in feats.values() for k, c in enumerate(f)})
    vocab = M.Vocabulary(atoms)
    corpus = [([vocab.state(feats[x]) for x in "pqrstqt"], 2), ([vocab.state(feats[x]) for x in "ts"], 5)]
    M.Trainer(vocab, corpus, cross=False, allowed_slots={1, 2}).train(len(vocab) + 2)
    for f in feats.values():
        path = vocab.merge_path(vocab.state(f))
        assert path[0] == vocab.state(f)
        assert all(len(x) - len(y) == 1 for x, y in zip(path, path[1:], strict=False))
        assert all(vocab.decode(x) == f for x in path)
        assert M.choose_stage(path, "raw") == path[0] and M.choose_stage(path, "full") == path[-1]
        assert M.choose_stage(path, "middle") == path[(len(path) - 1) // 2]


def test_decode_rejects_bad_states():
    vocab = M.Vocabulary([(0, 1), (0, 2), (1, 3)])
    assert vocab.decode([1, 3]) == [1, 3]
    assert vocab.decode([0, 3]) is None and vocab.decode([1, 2]) is None and vocab.decode([1]) is None and vocab.decode([1, 99]) is None


def test_empty_state_takes_the_token_in_front():
    chain = M.Chain([[1], [2], [3]])
    chain.apply(1, 2, 9)
    # both states ran empty: the first goes, the second takes the merged token
    assert chain.tokens() == [9, 3]


def test_distributed_masses_equal_the_chain(spark):
    atoms, corpus = random_corpus(3)
    rows = [(k, pos, state) for k, (states, _) in enumerate(corpus) for pos, state in enumerate(states)]
    df = spark.createDataFrame(rows, "seq long, pos int, state array<int>").repartition(4)
    got = {(r["seq"], r["a"], r["b"]): r["mass"] for r in M.pair_masses(df, "seq").collect()}
    want = {(k, a, b): w for k, (states, _) in enumerate(corpus) for (a, b), w in M.Chain(states).masses().items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_recursive_decode_and_round_trip(spark):
    atoms, corpus = random_corpus(1)
    vocab = M.Trainer(M.Vocabulary(atoms), corpus).train(20)
    table = M.vocabulary_table(spark, vocab)
    again = M.from_table(table)
    assert again.rules == vocab.rules and again.atoms == vocab.atoms
    parts = M.atoms_of(table).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("slot", "code"))).alias("p")).collect()
    assert {r["token"]: [tuple(x) for x in r["p"]] for r in parts} == {t: sorted(vocab.parts(t)) for t in range(1, len(vocab))}
    assert len(M.from_table(table, 15)) == 15


@pytest.mark.parametrize("mode", ["feature", "none", "token"])
def test_encoding_does_not_depend_on_partitions(spark, mode):
    atoms, corpus = random_corpus(2)
    vocab = M.Trainer(M.Vocabulary(atoms), corpus).train(20)
    rows = [(k, [[vocab.atoms[t][1] for t in s] for s in states]) for k, (states, _) in enumerate(corpus)]
    df = spark.createDataFrame(rows, "k long, feats array<array<int>>")
    one = sorted(map(tuple, [(r["k"], tuple(r["tokens"])) for r in M.encode_sequences(df.coalesce(1), vocab, "k", mode).collect()]))
    two = sorted(map(tuple, [(r["k"], tuple(r["tokens"])) for r in M.encode_sequences(df.repartition(5), vocab, "k", mode).collect()]))
    assert one == two


def merge_rows(*rows):
    return [("merge", k, 50 + k, a, b, ra, rb, slots, float(10 - k), 2.0) for k, (a, b, ra, rb, slots) in enumerate(rows, 1)]


def test_permutation_of_a_short_log(spark):
    rows = merge_rows((11, 31, [0, 4], [2, 4], [0, 2]), (12, 32, [1, 9], [3, 9], [1, 3]), (13, 14, [2, 8], [3, 3], [2, 3]), (15, 16, [0, 0], [3, 0], [0, 3]))
    log = spark.createDataFrame(rows, L.SCHEMA)
    got = {r["metric"]: r for r in L.slot_permutation_test(log, [0, 1], [2, 3]).collect()}
    assert len(L.partitions([0, 1, 2, 3], 2)) == 6
    rate = got["direct_cross_rate_among_pure"]
    pairs = [{0, 2}, {1, 3}, {2, 3}, {0, 3}]
    rates = [sum(len(p & set(text)) == 1 for p in pairs) / 4 for text in itertools.combinations(range(4), 2)]
    assert rate["observed"] == pytest.approx(3 / 4) and rate["p_greater_equal"] >= sum(x >= 3 / 4 for x in rates) / 6


def test_transitions_of_a_short_log(spark):
    rows = merge_rows(
        (1, 2, [2, 5], [3, 6], [2, 3]), (3, 4, [0, 1], [1, 1], [0, 1]), (52, 51, [-1, 3, 4], [-1, 1, 2], [0, 1, 2, 3]), (5, 53, [3, 2], [-1, 52, 51], [0, 1, 2, 3]), (1, 6, [2, 5], [4, 7], [2, 4])
    )
    out = L.classified(spark.createDataFrame(rows, L.SCHEMA), [0, 1], [2, 3], 4)
    assert {r["step"]: r["transition"] for r in out.collect()} == {1: "image_image", 2: "text_text", 3: "text_image", 4: "mixed_image", 5: "hash_related"}
    assert {r["output"]: (r["n"], r["n_hash"]) for r in L.output_composition(out).collect()} == {"text_only": (1, 0), "image_only": (2, 1), "text_image": (2, 0)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_queries_train_and_encode_whole_sequences(spark):
    from strandline.plans import merging
    from strandline.plans.inputs import purchases, slot_items

    d = "/root/testdata/sf0.001"
    feats = {r["item"]: list(r["feats"]) for r in slot_items(spark, d).collect()}
    seqs: dict = {}
    for r in sorted(purchases(spark, d).collect(), key=lambda r: (r["ts"], r["okey"], r["line"], r["item"], r["supp"])):
        seqs.setdefault(r["user"], []).append(feats[r["item"]])
    atoms = sorted({(k, c) for seq in seqs.values() for f in seq for k, c in enumerate(f)})
    vocab = M.Vocabulary(atoms)
    slow = slow_train(vocab, [([vocab.state(f) for f in seq], 1) for seq in seqs.values()], 160)
    log = sorted(merging.trained_merges(spark, d).collect(), key=lambda r: r["step"])
    assert [(r["new_token"], r["left"], r["right"]) for r in log] == [(len(atoms) + 1 + k, *pair) for k, pair in enumerate(slow.rules)]
    assert [r["priority"] for r in log] == pytest.approx(slow.priority)
    vocab = M.Vocabulary(atoms)
    for r in log:
        vocab.add(r["left"], r["right"], r["priority"])
    got = {r["user"]: r["tokens"] for r in merging.encoded_sequences(spark, d).collect()}
    for user, seq in seqs.items():
        assert got[user] == " ".join(map(str, vocab.encode_best([vocab.state(f) for f in seq])))
