"""Training on tables against the trainer of one process, replay of logs, and encoding of long sequences."""

import random
import time

import pytest

from strandline.operators import training as R
from strandline.operators import vocabulary as M
from tests.test_vocabulary import slow_encode

SAME = ("step", "new_token", "left", "right", "affected_sequences", "merge_types", "slots")


def corpus(seed, n=40, items=6, slots=3, codes=4):
    rng = random.Random(seed)
    seqs = [[[rng.randrange(codes) for _ in range(slots)] for _ in range(rng.randint(1, items))] for _ in range(n)]
    return seqs + rng.choices(seqs, k=n // 2)


def table(spark, seqs):
    return spark.createDataFrame([(k, s) for k, s in enumerate(seqs)] + [(-1, None), (-2, [])], "user long, feats array<array<int>>").repartition(3)


def in_one_process(seqs, size, **options):
    counted = {}
    for s in seqs:
        counted[str(s)] = (s, counted.get(str(s), (s, 0))[1] + 1)
    vocab = M.Vocabulary(sorted({(k, c) for s in seqs for f in s for k, c in enumerate(f)}))
    trainer = M.Trainer(vocab, [([vocab.state(f) for f in s], n) for s, n in counted.values()], **options)
    trainer.train(size)
    return trainer


def same(log, want):
    assert [{k: r[k] for k in SAME} for r in log] == [{k: r[k] for k in SAME} for r in want]
    assert [r["priority"] for r in log] == pytest.approx([r["priority"] for r in want])


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"cross": False}), (3, {"allowed_slots": {0, 2}}), (4, {})])
def test_tables_give_the_log_of_one_process(spark, monkeypatch, seed, options):
    if seed == 4:  # rounds, rewriting and summing up at their smallest
        for name, value in (("CANDIDATES", 3), ("REWRITE", 2), ("COMPACT", 2), ("HELD", 10)):
            monkeypatch.setattr(R, name, value)
    seqs = corpus(seed)
    want = in_one_process(seqs, 30, **options)
    vocab, log = R.train_on_tables(table(spark, seqs), 30, **options)
    assert vocab.rules == want.vocab.rules and vocab.atoms == want.vocab.atoms
    same(log, want.log)


def test_training_ends_when_no_pair_is_left(spark):
    vocab, log = R.train_on_tables(table(spark, [[[1, 2]], [[1, 2]], [[3, 2]]]), 100)
    assert [(r["left"], r["right"], r["affected_sequences"]) for r in log] == [(1, 3, 2), (2, 3, 1)] and len(vocab) == 6
    vocab, log = R.train_on_tables(table(spark, []), 10)
    assert len(vocab) == 1 and log == []


def test_a_log_is_replayed_and_training_goes_on(spark):
    seqs = corpus(5)
    want = in_one_process(seqs, 30)
    _, log = R.replayed(table(spark, seqs), want.log[:9], 30)
    same(log, want.log)
    wrong = [dict(r) for r in want.log[:9]]
    wrong[6]["left"], wrong[6]["right"] = wrong[8]["left"], wrong[8]["right"]
    with pytest.raises(ValueError, match="step 7 merges"):
        R.replayed(table(spark, seqs), wrong)
    wrong = [dict(r) for r in want.log[:9]]
    wrong[4]["priority"] += 1
    with pytest.raises(ValueError, match="step 5 has the priority"):
        R.replayed(table(spark, seqs), wrong)
    with pytest.raises(ValueError, match="no pair is left|merges"):
        R.replayed(table(spark, [[[1, 2]]]), [{"step": 1, "left": 1, "right": 2, "priority": 1.0}, {"step": 2, "left": 1, "right": 3, "priority": 1.0}])


def test_the_same_corpus_is_trained_on_once(spark, monkeypatch):
    seqs = corpus(6)
    vocab, log = R.trained_once(table(spark, seqs), 25)
    monkeypatch.setattr(R, "train_on_tables", None)
    again, _ = R.trained_once(table(spark, seqs[::-1]), 25)
    assert again.rules == vocab.rules and again.priority == vocab.priority and log.count() == len(vocab.rules)
    with pytest.raises(TypeError):
        R.trained_once(table(spark, seqs), 26)


@pytest.mark.parametrize("seed", range(6))
def test_encoding_equals_the_slow_form_on_longer_sequences(seed):
    seqs = corpus(seed, n=30, items=30, codes=2 + seed % 3)
    vocab = in_one_process(seqs, 60).vocab
    for s in seqs:
        states = [vocab.state(f) for f in s]
        slow = slow_encode(vocab, states)
        assert vocab.encode_best(states) == slow.tokens()
        assert vocab.encode_best(states, path=True)[-1] == slow.tokens()


def test_encoding_takes_time_in_proportion():
    seqs = corpus(9, n=40, items=20)
    vocab = in_one_process(seqs, 80).vocab
    rng = random.Random(1)
    long = [vocab.state([rng.randrange(4) for _ in range(3)]) for _ in range(5000)]
    times = []
    for n in (1000, 5000):
        began = time.process_time()
        tokens = vocab.encode_best(long[:n])
        times.append(time.process_time() - began)
    assert times[1] < 15 * times[0] and len(tokens) < 15000
    atoms = sorted(t for s in long for t in s)
    assert sorted(vocab.index[a] for t in tokens for a in vocab.parts(t)) == atoms
