"""Beam search over tables against the search of one example and against exhaustion."""

import itertools
import math
import random

import pytest

from strandline.operators import search as B

EOS = 1


def random_scores(seed, contexts=3, steps=4):
    rng = random.Random(seed)
    rows = []
    for c in range(contexts):
        for k in range(steps):
            for prev in [B.START] if k == 0 else range(2, 7):
                rows += [(c, k, prev, t, rng.choice([-0.5, -1.0, -2.0, rng.uniform(-4, 0)])) for t in range(1, 7) if rng.random() < 0.8]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "context int, step int, prev int, token int, score double").repartition(3)


def one(rows, context):
    after = {}
    for c, k, prev, t, s in rows:
        if c == context:
            after.setdefault((k, prev), {})[t] = s
    return lambda prefix: after.get((len(prefix), prefix[-1] if prefix else B.START), {})


def found(out):
    got = {}
    for r in out.collect():
        got.setdefault(r["example"], []).append((r["rank"], tuple(r["tokens"]), r["score"]))
    return {k: [(t, s) for _, t, s in sorted(v)] for k, v in got.items()}


@pytest.mark.parametrize("seed", range(3))
def test_all_examples_at_once_equal_one_by_one(spark, seed):
    rows = random_scores(seed)
    examples = spark.createDataFrame([(10 + k, k % 3) for k in range(7)] + [(10, 0), (50, 9), (51, None)], "example long, context int")
    got = found(B.search_table(examples, table(spark, rows), EOS, 4, 3, 2))
    assert set(got) == set(range(10, 17))
    for k, paths in got.items():
        want = B.beam_search(one(rows, (k - 10) % 3), EOS, 4, 3, 2)
        # one by one the search ends early once nothing can displace what has ended, and fills up only what is missing
        best = wide(rows, (k - 10) % 3, 3)[:2]
        assert [t for t, _ in paths] == [t for t, _ in best] and [s for _, s in paths] == pytest.approx([s for _, s in best])
        if len(want) == 2 and all(t[-1] == EOS for t, _ in paths):
            assert [t for t, _ in paths] == [t for t, _ in want]


def wide(rows, context, beams, end_aware=True):
    """The same search in plain loops."""
    score, live, ended = one(rows, context), [((), 0.0)], []
    order = lambda x: (-round(x[1], 9), x[0])
    for _ in range(4):
        grown = [((*p, t), s + x) for p, s in live for t, x in score(p).items()]
        if end_aware:
            ended += [x for x in grown if x[0][-1] == EOS]
            grown = [x for x in grown if x[0][-1] != EOS]
        live = sorted(grown, key=order)[:beams]
    return sorted(ended + live, key=order)


@pytest.mark.parametrize("end_aware", [True, False])
def test_wide_beams_find_what_exhaustion_finds(spark, end_aware):
    rows = [r for r in random_scores(7, 1) if end_aware or r[1] == 3 or r[3] != EOS]
    got = found(B.search_table(spark.createDataFrame([(1, 0)], "example int, context int"), table(spark, rows), EOS, 4, 2000, 9, end_aware))[1]
    score, every = one(rows, 0), []
    for n in range(1, 5):
        for path in itertools.product(range(1, 7), repeat=n):
            whole = path[-1] == EOS and EOS not in path[:-1] if end_aware and n < 4 else n == 4 and (not end_aware or EOS not in path[:-1])
            total = [score(path[:k]).get(t, -math.inf) for k, t in enumerate(path)]
            if whole and -math.inf not in total:
                every.append((path, sum(total)))
    every.sort(key=lambda x: (-round(x[1], 9), x[0]))
    assert [t for t, _ in got] == [t for t, _ in every[:9]] and [s for _, s in got] == pytest.approx([s for _, s in every[:9]])


def test_fixed_length_equals_plain_loops(spark):
    rows = random_scores(11)
    got = found(B.search_table(spark.createDataFrame([(k, k) for k in range(3)], "example int, context int"), table(spark, rows), EOS, 4, 4, 3, False))
    for k in range(3):
        want = wide(rows, k, 4, False)[:3]
        assert [t for t, _ in got.get(k, [])] == [t for t, _ in want]


def test_the_grammar_masks_and_the_rest_adds_up_to_one(spark):
    rows = random_scores(3)
    grammar = spark.createDataFrame([(0, 2), (0, 3), (1, 4), (1, 4), (2, 5), (2, 1), (3, 1)], "step int, token int")
    got = B.constrained(table(spark, [*rows, (0, 0, B.START, 2, -math.inf)]), grammar).collect()
    total = {}
    for r in got:
        assert (r["step"], r["token"]) in {(0, 2), (0, 3), (1, 4), (2, 5), (2, 1), (3, 1)}
        total[r["context"], r["step"], r["prev"]] = total.get((r["context"], r["step"], r["prev"]), 0) + math.exp(r["score"])
    assert list(total.values()) == pytest.approx([1.0] * len(total))
    with pytest.raises(ValueError, match="returns"):
        B.search_table(grammar, grammar, 1, 3, 1, 2)
