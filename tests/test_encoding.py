"""Encoding of many sequences at once against that of single ones."""

import random
import time

import numpy as np
import pytest

from strandline.operators import encoding as E
from strandline.operators import vocabulary as M


def learnt(rng, slots, codes, size, items=8):
    seqs = [[[rng.randrange(codes) for _ in range(slots)] for _ in range(rng.randint(1, items))] for _ in range(60)]
    vocab = M.Vocabulary(sorted({(k, c) for s in seqs for f in s for k, c in enumerate(f)}))
    M.Trainer(vocab, [([vocab.state(f) for f in s], 1) for s in seqs]).train(size)
    return vocab, seqs


def flat(vocab, seqs):
    rows = [vocab.state(f) for s in seqs for f in s]
    return np.array(rows, np.int32).reshape(-1, vocab.slots), np.array([len(s) for s in seqs])


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("dense", [True, False])
def test_blocks_equal_single_sequences(monkeypatch, seed, dense):
    monkeypatch.setattr(E, "FEW", seed % 3)
    monkeypatch.setattr(E, "DENSE", E.DENSE if dense else 0)
    rng = random.Random(seed)
    vocab, seqs = learnt(rng, 1 + seed % 4, 2 + seed % 3, 90, 3 + 5 * (seed % 5))
    if seed % 2:  # equal priorities: the first in reading order wins
        vocab.priority = [float(round(p, -1)) for p in vocab.priority]
    seqs.insert(5, [])
    out, counts = E.Encoder(vocab).encode(*flat(vocab, seqs))
    got = [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])]
    assert got == [vocab.encode_best([vocab.state(f) for f in s]) for s in seqs]


@pytest.mark.parametrize("scope", ["sequence", "item"])
def test_encode_sequences(spark, scope):
    vocab, seqs = learnt(random.Random(3), 3, 4, 60)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)] + [(-1, [])], "user long, feats array<array<int>>")
    got = {r["user"]: r["tokens"] for r in M.encode_sequences(df, vocab, "user", "none", scope).collect()}
    assert got.pop(-1) == []
    for k, s in enumerate(seqs):
        parts = [s] if scope == "sequence" else [[f] for f in s]
        assert got[k] == [t for part in parts for t in vocab.encode_best([vocab.state(f) for f in part])]


def test_a_code_that_is_not_known_is_an_error(spark):
    vocab, _ = learnt(random.Random(3), 3, 4, 30)
    df = spark.createDataFrame([(1, [[0, 1, 99]])], "user long, feats array<array<int>>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        M.encode_sequences(df, vocab, "user").collect()


def test_many_sequences_are_encoded_at_once(spark):
    rng = random.Random(1)
    vocab, _ = learnt(rng, 3, 10, 120, 40)
    seqs = [[[rng.randrange(10) for _ in range(3)] for _ in range(40)] for _ in range(2000)]
    tokens, sizes = flat(vocab, seqs)
    began = time.process_time()
    E.Encoder(vocab).encode(tokens, sizes)
    fast, began = time.process_time() - began, time.process_time()
    for s in seqs[:400]:
        vocab.encode_best([vocab.state(f) for f in s])
    assert 3 * fast < 5 * (time.process_time() - began)
