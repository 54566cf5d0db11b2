"""Merges in many sequences at once against those of a single chain."""

import random
import time

import numpy as np
import pytest

from strandline.operators import training as R
from strandline.operators import vocabulary as M


def block_of(states, counts, slots):
    rows = [[*s, *[0] * (slots - len(s))] for seq in states for s in seq]
    tokens = np.ascontiguousarray(np.array(rows, np.int32).reshape(-1, slots).T)
    return R._Block(tokens, np.zeros(len(rows), np.int32), np.array([len(s) for s in states]), np.array(counts))


def drawn(rng, n, items, slots, codes):
    return [[[1 + k * codes + rng.randrange(codes) for k in range(rng.randint(1, slots))] for _ in range(rng.randint(1, items))] for _ in range(n)]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("cross", [True, False])
def test_a_block_merges_as_chains_do(seed, cross):
    rng = random.Random(seed)
    slots, codes = 2 + seed % 3, 1 + seed % 4
    states, scale = drawn(rng, 30, 12, slots, codes), 144
    counts = [rng.randint(1, 3) for _ in states]
    block, chains = block_of(states, counts, slots), [M.Chain(s) for s in states]
    size = 200
    for token in range(slots * codes + 1, slots * codes + 25):
        want: dict = {}
        for n, c in zip(counts, chains, strict=True):
            for p, w in c.masses(None, cross).items():
                want[p] = want.get(p, 0) + w * n
        found, value = block.masses(size, scale, cross, None)
        assert {divmod(p, size): pytest.approx(v / scale) for p, v in zip(found.tolist(), value, strict=True)} == want
        if not want:
            break
        low, high = rng.choice(sorted(want))
        made: dict = {}
        for n, c in zip(counts, chains, strict=True):
            places = c.places(low, high, cross)
            if places:
                made["sequences"] = made.get("sequences", 0) + n
                for kind, m in c.apply(low, high, token, cross, places).items():
                    made[kind] = made.get(kind, 0) + m * n
        seen: list = []
        look = lambda b, flags: seen.append(dict(zip(*(x.tolist() for x in b.masses(size, scale, cross, None, flags)), strict=True)))  # noqa: B023, E731
        before = dict(zip(*(x.tolist() for x in block.masses(size, scale, cross, None)), strict=True))
        assert block.merge(low, high, token, cross, look, look) == made
        after = dict(zip(*(x.tolist() for x in block.masses(size, scale, cross, None)), strict=True))
        for p in before.keys() | after.keys() | seen[0].keys() | seen[1].keys():
            assert after.get(p, 0) - before.get(p, 0) == seen[1].get(p, 0) - seen[0].get(p, 0)
        ends = np.flatnonzero(block.last) + 1
        for c, own, slot in zip(chains, np.split(block.tokens.T, ends), np.split(block.between, ends), strict=False):
            assert [sorted(s) for s in c.states] == [sorted(t for t in s if t) for s in own.tolist()]
            assert [t or 0 for t in c.between] == slot[:-1].tolist()


def test_many_sequences_are_merged_at_once():
    rng = random.Random(1)
    states = drawn(rng, 3000, 40, 3, 10)
    block, chains = block_of(states, [1] * len(states), 3), [M.Chain(s) for s in states]
    pairs = [(1 + k, 11 + k) for k in range(10)]
    began = time.process_time()
    for token, (low, high) in enumerate(pairs, 31):
        for c in chains:
            places = c.places(low, high)
            if places:
                c.masses(None, True, places)
                c.apply(low, high, token, True, places)
                c.masses(None, True, None if c.moved else places)
    slow, began = time.process_time() - began, time.process_time()
    for token, (low, high) in enumerate(pairs, 31):
        look = lambda b, flags: b.masses(60, 36, True, None, flags)
        block.merge(low, high, token, True, look, look)
    assert 4 * (time.process_time() - began) < slow
