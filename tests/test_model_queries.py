"""Queries that SQL cannot express, as a whole against plain Python."""

import itertools
import os
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import merge_log as L
from strandline.operators import vocabulary as M
from strandline.plans import merging
from strandline.plans.inputs import log_of_merges, purchases, slot_items

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def trained(spark):
    """Feats by item, items by user in order of time, and the vocabulary of the one-process trainer."""
    feats = {r["item"]: list(r["feats"]) for r in slot_items(spark, SF).collect()}
    seqs: dict = {}
    for r in sorted(purchases(spark, SF).collect(), key=lambda r: (r["ts"], r["okey"], r["line"], r["item"], r["supp"])):
        seqs.setdefault(r["user"], []).append(r["item"])
    used = [[feats[i] for i in s] for s in seqs.values()]
    vocab = M.Vocabulary(sorted({(k, c) for s in used for f in s for k, c in enumerate(f)}))
    counted = Counter(str(s) for s in used)
    distinct = {str(s): s for s in used}
    M.Trainer(vocab, [([vocab.state(f) for f in distinct[k]], n) for k, n in counted.items()]).train(160)
    return feats, seqs, vocab


def test_merge_path_stages(spark, trained):
    feats, _, vocab = trained
    want = Counter(len(vocab.merge_path(vocab.state(f))) for f in {tuple(f) for f in feats.values()})
    assert {r["stages"]: r["n"] for r in merging.merge_path_stages(spark, SF).collect()} == want


def test_history_policies(spark, trained):
    feats, _, vocab = trained
    keys = spark.createDataFrame([(k,) for k in feats], "item long").select("item", F.xxhash64(F.lit(2024), "item").alias("h")).collect()
    draw = {r["item"]: r["h"] for r in keys}
    want: Counter = Counter()
    for item, f in feats.items():
        path = vocab.merge_path(vocab.state(f))
        for policy in ("raw", "full", "middle", "random"):
            want[policy] += len(M.choose_stage(path, policy, draw[item]))
    got = {r["policy"]: (r["n"], r["n_tokens"]) for r in merging.history_policies(spark, SF).collect()}
    assert got == {p: (len(feats), n) for p, n in want.items()} and want["full"] < want["raw"]


@pytest.mark.parametrize("split", ["test", "train"])
def test_model_examples(spark, trained, split):
    feats, seqs, vocab = trained
    bos, eos = len(vocab), len(vocab) + 1
    want: Counter = Counter()
    for user, seq in seqs.items():
        targets = [len(seq) - 1] if split == "test" else range(1, len(seq) - 2)
        for t in targets:
            if t < 1:
                continue
            ids = [bos, *[x for i in seq[max(0, t - 20) : t] for x in vocab.merge_path(vocab.state(feats[i]))[-1]], eos]
            label = [*vocab.state(feats[seq[t]]), eos]
            rows = (ids + [0] * (64 - len(ids)), [1] * len(ids) + [0] * (64 - len(ids)), label + [-100] * (4 - len(label)))
            want[user, *(" ".join(map(str, x)) for x in rows)] += 1
    query = merging.model_examples if split == "test" else merging.train_examples
    assert Counter((r["user"], r["input_ids"], r["attention_mask"], r["labels"]) for r in query(spark, SF).collect()) == want


def plain_kind(slots, text, image):
    if slots is None or any(s not in text | image | {8} for s in slots):
        return "unknown"
    if 8 in slots:
        return "hash"
    return "mixed" if slots & text and slots & image else "text" if slots & text else "image" if slots & image else "unknown"


def plain_transition(a, b):
    if "hash" in (a, b):
        return "hash_related"
    if "unknown" in (a, b):
        return "unknown"
    if a == b:
        return f"{a}_{b}"
    if {a, b} == {"text", "image"}:
        return "text_image"
    return f"mixed_{b if a == 'mixed' else a}"


def test_slot_permutation(spark):
    rows = sorted(log_of_merges(spark, SF).collect(), key=lambda r: r["step"])
    made, steps = {}, []
    for r in rows:
        side = [{rule[0]} if rule[0] >= 0 else made.get(t) for t, rule in ((r["left"], r["left_rule"]), (r["right"], r["right_rule"]))]
        steps.append((set(r["slots"]), *side))
        made[r["new_token"]] = set(r["slots"])
    values = {}
    for text in itertools.combinations(range(8), 4):
        t, i = set(text), set(range(8)) - set(text)
        kinds = Counter(plain_transition(plain_kind(a, t, i), plain_kind(b, t, i)) for _, a, b in steps)
        pure, fused, both = (sum(kinds[x] for x in set(names)) for names in (L.PURE, L.FUSION, [*L.PURE, *L.FUSION]))
        mixed = sum(bool(o & t and o & i and o <= t | i | {8}) for o, _, _ in steps)
        values[text] = (kinds["text_image"] / pure, fused / both, mixed / len(steps))
    got = {r["metric"]: r for r in merging.slot_permutation(spark, SF).collect()}
    for k, name in enumerate(("direct_cross_rate_among_pure", "fusion_rule_rate_no_hash", "output_mixed_rate")):
        every, real = [v[k] for v in values.values()], values[0, 1, 2, 3][k]
        mean, std, r = statistics.fmean(every), statistics.pstdev(every), got[name]
        near = lambda x: pytest.approx(x, abs=2e-6)
        assert r["observed"] == near(real) and r["null_mean"] == near(mean) and r["null_std"] == near(std)
        assert r["null_min"] == near(min(every)) and r["null_max"] == near(max(every)) and r["z_score"] == pytest.approx((real - mean) / std, rel=1e-4, abs=2e-6)
        assert r["p_greater_equal"] == near(sum(x >= real - 1e-12 for x in every) / 70) and r["p_less_equal"] == near(sum(x <= real + 1e-12 for x in every) / 70)
        assert r["p_two_sided"] == near(sum(abs(x - mean) >= abs(real - mean) - 1e-12 for x in every) / 70)
