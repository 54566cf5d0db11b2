import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import examples as X
from strandline.operators import registry, search
from strandline.operators import vocabulary as M
from strandline.sources import encoders


def trained():
    feats = {"p": [7, 1, 5], "q": [7, 2, 6], "r": [8, 2, 5], "s": [8, 1, 6], "t": [9, 2, 6]}
    vocab = M.Vocabulary(sorted({(k, c) for f in feats.values() for k, c in enumerate(f)}))
    M.Trainer(vocab, [([vocab.state(feats[x]) for x in "pqrstqt"], 2)], cross=False, allowed_slots={1, 2}).train(len(vocab) + 2)
    return feats, vocab


def test_policies_choose_their_stage(spark):
    feats, vocab = trained()
    items = spark.createDataFrame(list(feats.items()), "item string, feats array<int>")
    paths = items.join(X.merge_paths(items, vocab), "feats")
    for policy in ("raw", "full", "middle"):
        got = {r["item"]: r["tokens"] for r in X.history_tokens(paths, policy, ["item"]).collect()}
        assert got == {k: M.choose_stage(vocab.merge_path(vocab.state(f)), policy) for k, f in feats.items()}
    one = {r["item"]: r["tokens"] for r in X.history_tokens(paths, "random", ["item"]).collect()}
    two = {r["item"]: r["tokens"] for r in X.history_tokens(paths.repartition(3), "random", ["item"]).collect()}
    assert one == two and all(vocab.decode(t) == feats[k] for k, t in one.items())
    with pytest.raises(ValueError):
        X.history_tokens(paths, "other", ["item"])
    assert X.path_summary(paths).first()["n_states"] == 5


def test_assembled_examples(spark):
    rows = spark.createDataFrame([(1, [5, 6, 7], [1, 2], 2)], "k int, tokens array<int>, label array<int>, n_items int")
    r = X.assemble(rows, 10, 4, 90, 91, control=[8, 9]).first()
    assert r["input_ids"] == [90, 5, 6, 7, 8, 9, 8, 9, 91, 0]
    assert r["attention_mask"] == [1] * 9 + [0] and r["labels"] == [1, 2, 91, -100]
    with pytest.raises(Exception):
        X.assemble(rows, 4, 4, 90, 91).collect()


def test_examples_of_texts_are_those_of_tokens(spark):
    rng = random.Random(3)
    drawn = [(k, [[rng.randrange(300) for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(1, 6))], [rng.randrange(9) for _ in range(3)]) for k in range(40)]
    rows = spark.createDataFrame(drawn, "k int, h array<array<int>>, label array<int>")
    want = X.assemble(rows.select("k", F.flatten("h").alias("tokens"), "label"), 20, 4, 300, 301)
    want = {r["k"]: tuple(r)[1:] for r in want.select("k", *[F.array_join(c, " ") for c in ("input_ids", "attention_mask", "labels")]).collect()}
    texts = rows.select("k", F.transform("h", X.spelt).alias("texts"), F.transform("h", F.size).alias("counts"), F.array_join(X.padded_label("label", 4, 301), " ").alias("labels"))
    out = X.assemble_texts(texts, 20, 300, 301)
    assert {r["k"]: (r["input_ids"], r["attention_mask"], r["labels"]) for r in out.collect()} == want
    with pytest.raises(Exception, match="wider"):
        X.assemble_texts(texts, 4, 300, 301).collect()


def test_labels_are_atoms(spark):
    feats, vocab = trained()
    items = spark.createDataFrame(list(feats.items()), "item string, feats array<int>")
    assert {r["item"]: r["label"] for r in X.label_atoms(items, vocab).collect()} == {k: vocab.state(f) for k, f in feats.items()}


def test_datasets_by_name(spark, tmp_path):
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write('{"reviewerID": "u", "asin": "i", "unixReviewTime": 2}\n')
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        f.write("{'asin': 'i', 'title': 'A &amp; <b>B</b>', 'categories': [['Toys,', 'Games.']], 'price': '3'}\n")
        f.write("{'asin': 'j', 'title': 'unused'}\n")
    data = registry.find("dataset", "reviews")({"toys": str(tmp_path / "r.json.gz")}, {"toys": str(tmp_path / "m.json.gz")})
    assert data.interactions(spark).select("user", "item", "ts").collect() == [("u", "i", 2)]
    assert data.texts(spark).collect() == [("i", "A & B 3 Toys, Games. ")]
    two = registry.find("dataset", "reviews")({c: str(tmp_path / "r.json.gz") for c in "xy"}, {})
    assert {r["user"] for r in two.interactions(spark).collect()} == {"x::u", "y::u"}
    with pytest.raises(KeyError):
        registry.find("dataset", "none")
    with pytest.raises(ValueError):
        registry.register("dataset", "reviews")(object)


def test_streamed_counts_drop_late_events(spark, tmp_path):
    from strandline.streaming import sequences as S

    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 1), ("2024-01-02 01:00:00", 2)]
    df = spark.createDataFrame(rows, "t string, user int").select(F.to_timestamp("t").alias("ts"), "user")
    df.write.parquet(str(tmp_path / "in"))
    stream = S.event_stream(spark, str(tmp_path / "in"), df.schema)
    q = S.windowed_counts(stream, "ts", ["user"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["user"], r["n"]) for r in spark.table("counts").collect()) == [(1, 2), (2, 1)]


def all_endings(score, horizon, prefix=(), total=0.0):
    if len(prefix) == horizon:
        return
    for token, p in score(prefix).items():
        if token == 1:
            yield (*prefix, 1), total + p
        else:
            yield from all_endings(score, horizon, (*prefix, token), total + p)


@pytest.mark.parametrize("seed", range(5))
def test_wide_beams_find_what_exhaustion_finds(seed):
    def score(prefix):
        rng = random.Random(f"{seed}{prefix}")
        w = [rng.random() for _ in range(4)] if len(prefix) < 4 else [1.0]
        return {t: math.log(x / sum(w)) for t, x in enumerate(w, 1)}

    want = sorted(all_endings(score, 5), key=lambda x: (-x[1], x[0]))[:6]
    got = search.beam_search(score, 1, 5, beams=400, returns=6)
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])


def test_an_ended_sequence_is_scored_once_and_survives():
    def score(prefix):
        assert 1 not in prefix
        return {1: math.log(0.4), 2: math.log(0.6)} if not prefix else {1: math.log(0.5), 3: math.log(0.5)}

    for horizon in (3, 9):
        got = search.beam_search(score, 1, horizon, beams=2, returns=2)
        assert got[0] == ((1,), pytest.approx(math.log(0.4))) and got[1] == ((2, 1), pytest.approx(math.log(0.3)))
    never = search.beam_search(lambda p: {2: -1.0, 3: -2.0}, 1, 2, beams=3, returns=2)
    assert never == [((2, 2), -2.0), ((2, 3), -3.0)]


def test_the_grammar_bounds_the_search(spark):
    feats, vocab = trained()
    steps = search.step_tokens(vocab, eos=99, control=[50])
    table = {(r["step"], r["token"]) for r in search.grammar_table(spark, steps).collect()}
    assert table == {(s, t) for (s, _), t in vocab.index.items()} | {(3, 50), (4, 99)}
    got = search.beam_search(lambda p: {t: -1.0 - t / 1000 for t in range(100)}, 99, 9, beams=50, returns=4, steps=steps)
    assert all(vocab.decode(list(tokens[:3])) is not None and tokens[3:] == (50, 99) for tokens, _ in got) and len(got) == 4


def test_encoders_try_again_and_tell_how_far_they_are(spark, tmp_path):
    waits, calls = [], []

    def flaky():
        def call(rows):
            calls.append(len(rows))
            if len(calls) < 4:
                raise ConnectionError
            return [[1.0]] * len(rows)

        return call

    assert encoders.retrying(flaky, sleep=waits.append)()([{}]) == [[1.0]] and waits == [1.0, 2.0, 4.0]
    calls.clear()
    with pytest.raises(RuntimeError, match="2 attempts"):
        encoders.retrying(flaky, attempts=2, sleep=waits.append)()([{}])

    def wrong():
        def call(rows):
            raise ValueError("bad input")

        return call

    with pytest.raises(ValueError, match="bad input"):
        encoders.retrying(wrong, sleep=waits.append)()([{}])
    items = spark.createDataFrame([(k, f"i{k}", "t") for k in range(5)], "id long, item string, text string")
    told = []

    def factory():
        return lambda rows: [[1.0, 2.0] for _ in rows]

    encoders.encode_resumable(items, factory, ["text"], 2, f"file://{tmp_path}/e", {}, step=2, progress=lambda a, b: told.append((a, b)))
    assert told == [(1, 3), (2, 3), (3, 3)]
