import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.functions import text as X
from strandline.functions import vectors as V
from strandline.operators import interactions as I
from strandline.operators import item_codes as K
from strandline.operators import ranking as G
from strandline.sources import artefacts as A
from strandline.sources import config, encoders
from strandline.sources import records as R


def test_lenient_json_gzip(spark, tmp_path):
    path = tmp_path / "r.json.gz"
    with gzip.open(path, "wt") as f:
        f.write('{"reviewerID": "u1", "asin": "b", "unixReviewTime": 5}\n')
        f.write("{'reviewerID': 'u1', 'asin': 'a', 'unixReviewTime': 5, 'x': true}\n")
        f.write("not a record\n\n")
        f.write('{"reviewerID": "u2", "asin": "a", "unixReviewTime": 1}\n')
    log = R.reviews(spark, str(path))
    assert log.count() == 3
    seqs = {r["user"]: r["seq"] for r in I.sequences(log).collect()}
    assert seqs == {"u1": ["b", "a"], "u2": ["a"]}  # equal times keep the file order


def test_behaviour_file(spark, tmp_path):
    path = tmp_path / "b.tsv"
    path.write_text("﻿carol\tq9 q4 q4\nada\tq4 q7 q9 q1\n")
    rows = R.behaviours(spark, str(path))
    assert R.behaviour_violations(rows).count() == 0
    seqs = rows.select("user", "seq")
    stats = I.dataset_stats(seqs).first()
    assert (stats["n_users"], stats["n_items"], stats["n_interactions"]) == (3, 5, 7)
    ids = I.first_appearance_ids(R.behaviour_log(rows), "item", [F.col("ord"), F.col("ts")])
    assert {r["item"]: r["id"] for r in ids.collect()} == {"q9": 1, "q4": 2, "q7": 3, "q1": 4}
    bad = tmp_path / "bad.tsv"
    bad.write_text("ada\tq1 q2\nbob\t  \nada\tq3\n")
    assert {r["rule"] for r in R.behaviour_violations(R.behaviours(spark, str(bad))).collect()} == {"repeated user", "empty sequence"}
    with pytest.raises(ValueError):
        R.require_empty(R.behaviour_violations(R.behaviours(spark, str(bad))), "behaviours")


def test_pairs_and_texts(spark, tmp_path):
    (tmp_path / "p.csv").write_text("\ufeffitem,user,timestamp\nq7,ada,31.5\n\n\"q,4\",ada,30\nq1, bob ,8,more\nq9,ada,31.5\n")
    log = R.pairs(spark, str(tmp_path / "p.csv")).withColumnRenamed("line", "ord")
    assert {r["user"]: r["seq"] for r in I.sequences(log).collect()} == {"ada": ["q,4", "q7", "q9"], "bob": ["q1"]}
    (tmp_path / "bad.csv").write_text("q1,ada,1\nq2,ada\n,ada,3\nq3,ada,soon\nq4,ada,nan\nq5,,5\nq6,ada,6\n")
    bad = R.pair_violations(spark, str(tmp_path / "bad.csv"))
    assert sorted(r["rule"] for r in bad.collect()) == ["empty", "empty", "fields", "time", "time"]
    with pytest.raises(ValueError, match="pairs in"):
        R.pairs(spark, str(tmp_path / "bad.csv"))
    assert [r["item"] for r in R.pairs(spark, str(tmp_path / "bad.csv"), check=False).collect()] == ["q1", "q6"]
    assert {r["user"] for r in R.pairs(spark, str(tmp_path / "bad.csv"), ("user", "item"), check=False).collect()} == {"q1", "q6"}
    (tmp_path / "t.csv").write_text('item_id,zh,en\nv1,"甲, 乙",one\nv2,,two\n')
    texts = R.item_texts(spark, str(tmp_path / "t.csv"))
    got = {r["item"]: r["t"] for r in texts.select("item", X.bilingual_text("zh", "en").alias("t")).collect()}
    assert got == {"v1": "Chinese: 甲, 乙\nEnglish: one", "v2": "two"}
    assert R.item_text_violations(texts).count() == 0


def test_manifests_and_images(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"item_id": "v1", "status": "downloaded", "path": "a/v1.jpg"}\n{"asin": "v2", "status": "missing"}\n')
    m = R.image_manifest(spark, str(tmp_path / "m.jsonl"))
    assert {r["item"] for r in m.collect()} == {"v1", "v2"} and R.manifest_violations(m).count() == 0
    pics = tmp_path / "pics"
    pics.mkdir()
    for n in ("v1.jpg", "v2.PNG", "x.txt"):
        (pics / n).write_bytes(b"abc")
    files = R.images(spark, str(pics))
    assert {r["item"] for r in files.collect()} == {"v1", "v2"}
    assert [r["item"] for r in R.available(m, files).collect()] == ["v1"]
    assert R.image_violations(files).count() == 0
    (pics / "v1.webp").write_bytes(b"x")
    assert [(r["rule"], r["item"]) for r in R.image_violations(R.images(spark, str(pics))).collect()] == [("repeated item", "v1")]
    assert {r["data"].split(";")[0] for r in R.image_base64(spark, str(pics / "v1.jpg")).collect()} == {"data:image/jpeg"}
    (tmp_path / "s.jsonl").write_text('{"item_id": "v1", "status": "failed"}\nbroken{\n{"item_id": "v1", "status": "downloaded"}\n')
    assert R.status_manifest(spark, str(tmp_path / "s.jsonl")).first()["status"] == "downloaded"
    assert R.discover(spark, str(tmp_path), ["none", "v1.jpg"]).endswith("pics/v1.jpg")


def test_batch_results(spark, tmp_path):
    lines = [{"item_id": "a", "embedding": [1.0]}, {"item_id": "b", "error": "x"}, {"item_id": "c", "embedding": [1.0]}, {"item_id": "c", "embedding": [1.0]}, {"item_id": "z", "embedding": [1.0]}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, lines)))
    want = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "item string")
    got = {r["item"]: r["problem"] for r in R.batch_results(spark, str(tmp_path / "b.jsonl"), want).collect()}
    assert got == {"b": "failed", "c": "repeated", "d": "missing", "z": "unexpected"}


def test_matrix_and_artefacts(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m.bin").write_bytes(m.tobytes())
    rows = {r["id"]: r["vec"] for r in A.read_matrix(spark, str(tmp_path / "m.bin"), 3).collect()}
    assert rows == {i + 1: m[i].tolist() for i in range(4)}
    with pytest.raises(ValueError):
        A.read_matrix(spark, str(tmp_path / "m.bin"), 5)
    df = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4, 5, 6])], "item string, codes array<int>")
    A.save(df, str(tmp_path / "codes"))
    with pytest.raises(Exception):
        A.save(df, str(tmp_path / "codes"))
    assert A.codes_table(spark, str(tmp_path / "codes"), 2).orderBy("item").first()["codes"] == [1, 2]
    one, two = A.manifest(df, "item", ["codes"]).first(), A.manifest(df.repartition(3), "item", ["codes"]).first()
    assert one == two and one["n_rows"] == 2


def test_utf8_can_be_strict(spark, tmp_path):
    (tmp_path / "r.json").write_bytes(b'{"reviewerID": "u", "asin": "\xff\xfe", "unixReviewTime": 1}\n{"reviewerID": "v", "asin": "a", "unixReviewTime": 2}\n')
    schema = "reviewerID string, asin string"
    assert R.lenient_json(spark, str(tmp_path / "r.json"), schema).count() == 2
    assert R.utf8_violations(R.numbered_lines(spark, str(tmp_path / "r.json"))).count() == 1
    with pytest.raises(Exception, match="UTF"):
        R.lenient_json(spark, str(tmp_path / "r.json"), schema, strict_utf8=True).collect()


def test_nested_fields_as_text(spark):
    rows = [('{"a": [" x ", {"b": 2, "c": null}], "d": ""}',), ("plain words",), (None,), ('["p", ["q", 1.5]]',)]
    df = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in df.select(X.flattened("v")).collect()] == ["x 2", "plain words", "", "p q 1.5"]
    made = df.limit(1).select(X.flattened(F.to_json(F.struct(F.array(F.lit("m"), F.lit("n")).alias("k"), F.lit(7).alias("z")))).alias("t"))
    assert made.first()["t"] == "m n 7"


def test_categories_are_checked():
    from strandline.operators.registry import categories_of

    assert categories_of(" Beauty, Baby,,") == ["Beauty", "Baby"] and categories_of(["one"], known=("one",)) == ["one"]
    for wrong in ("", [], "Beauty,Unheard", " , "):
        with pytest.raises(ValueError):
            categories_of(wrong)


def test_training_frequency(spark):
    df = spark.createDataFrame([("u", ["a", "b", "a", "c"]), ("v", ["a", "b"]), ("w", ["c", "d", "e"]), ("x", [])], "user string, seq array<string>")
    assert {r["item"]: r["n"] for r in I.training_frequency(df).collect()} == {"a": 1, "b": 1, "c": 1}


def test_vocabulary_catalogue_and_caches(spark, tmp_path):
    rows = [(1, 0, 0, 0, 5, 0.0), (2, 0, 0, 1, 6, 0.0), (3, 1, 2, -1, -1, 2.0), (4, 3, 1, -1, -1, 1.0)]
    A.save(spark.createDataFrame(rows, "token int, left int, right int, slot int, code int, priority double"), str(tmp_path / "vocab"))
    assert A.vocabulary(spark, str(tmp_path / "vocab")).count() == 4 and A.vocabulary(spark, str(tmp_path / "vocab"), 4).count() == 3
    for size in (2, 6):
        with pytest.raises(ValueError):
            A.vocabulary(spark, str(tmp_path / "vocab"), size)
    (tmp_path / "c.jsonl").write_text('{"item_id": "a", "title": "T", "image_url": "http://x"}\n{"item_id": "b", "text": "words"}\n')
    assert {(r["item_id"], r["title"], r["text"]) for r in R.catalogue(spark, str(tmp_path / "c.jsonl")).collect()} == {("a", "T", None), ("b", None, "words")}
    paths = spark.createDataFrame([([1, 2], [[1, 2], [3]])], "feats array<int>, path array<array<int>>")
    A.path_cache(paths, f"{tmp_path}/cache", "abc")
    A.path_cache(paths.limit(0), f"{tmp_path}/cache", "def")
    assert A.cached_paths(spark, f"{tmp_path}/cache", "abc").first()["path"] == [[1, 2], [3]] and A.cached_paths(spark, f"{tmp_path}/cache", "def").count() == 0
    out = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k int, v string")
    A.save_json(out, str(tmp_path / "json"), order=["k"])
    A.save_json(out.limit(3), str(tmp_path / "more"))
    A.save_json(out.limit(2), str(tmp_path / "more"), append=True)
    assert spark.read.json(str(tmp_path / "json")).count() == 20 and spark.read.json(str(tmp_path / "more")).count() == 5
    with pytest.raises(Exception):
        A.save_json(out, str(tmp_path / "json"))
    files = sorted((tmp_path / "json").glob("part-*"))
    ks = [json.loads(line)["k"] for f in files for line in f.read_text().splitlines()]
    assert ks == sorted(ks)


def test_config(tmp_path):
    assert config.parse_command_line(["--a=1", "--b", "[1, 2]", "--flag", "--c=__import__('os')"]) == {"a": 1, "b": [1, 2], "flag": True, "c": "__import__('os')"}
    (tmp_path / "c.yaml").write_text("a: 1\nb: text\n")
    assert config.layered({"a": 0, "z": 2}, str(tmp_path / "c.yaml"), {"b": 3}) == {"a": 1, "z": 2, "b": 3}
    (tmp_path / ".env").write_text('export K="v"\n# no\nL=2\n')
    assert config.read_env_file(str(tmp_path / ".env"), {}) == {"K": "v", "L": "2"}


def test_encoder_resumes_and_guards(spark, tmp_path):
    items = spark.createDataFrame([(0, "x", "a"), (1, "y", "bbbb"), (2, "z", None)], "id long, item string, text string")

    def factory():
        return lambda rows: [[float(len(r["text"])) + k for k in range(5)] for r in rows]

    folder = f"file://{tmp_path}/enc"
    out = encoders.encode_resumable(items, factory, ["text"], 3, folder, {"model": "m"}, step=2)
    got = {r["item"]: r["vec"] for r in out.collect()}
    assert got["z"] == [0.0, 0.0, 0.0] and np.allclose(got["x"], np.array([1, 2, 3]) / np.sqrt(14), atol=1e-6)

    def broken():
        raise AssertionError("nothing is left to encode")

    assert encoders.encode_resumable(items, broken, ["text"], 3, folder, {"model": "m"}, step=2).count() == 3
    moved = items.withColumn("id", 2 - F.col("id"))
    with pytest.raises(ValueError, match="item_order"):
        encoders.encode_resumable(moved, factory, ["text"], 3, folder, {"model": "m"}, step=2)


def test_codes_and_vectors(spark):
    df = spark.createDataFrame([("a", [1, 2, 3, 4]), ("b", [1, 2, 3, 4]), ("c", [0, 0, 0, 9])], "item string, codes array<int>")
    feats = K.with_collision_digit(df, buckets=8)
    assert K.repeated_tuples(feats).count() == 0
    with pytest.raises(Exception):
        K.with_collision_digit(spark.createDataFrame([(str(i), [1]) for i in range(3)], "item string, codes array<int>"), buckets=2).collect()
    assert df.select(C.pack_digits("codes").alias("p")).first()["p"] == [258, 772]
    with pytest.raises(Exception):
        spark.createDataFrame([([300, 1],)], "codes array<int>").select(C.pack_digits("codes")).collect()
    v = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = v.select(V.normalise("a").alias("n"), V.normalise("z").alias("z"), V.cosine("a", "z").alias("c")).first()
    assert r["n"] == pytest.approx([0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["c"] == 0.0
    with pytest.raises(Exception):
        v.select(V.normalise("z", strict=True)).collect()
    assert len(K.perfect_matchings(8)) == 105
    assert df.select(C.with_null_slots(F.array(*[F.lit(x) for x in (9, 8, 7, 6, 31, 32, 33, 34, 5)]), 4, 4)).first()[0] == [9, 8, 7, 6, 256, 256, 256, 256, 5]


def test_ranking_edge_cases(spark):
    preds = spark.createDataFrame([(1, 1, [-1]), (1, 2, [5]), (1, 3, [5]), (2, 1, [7])], "example long, rank int, codes array<int>")
    labels = spark.createDataFrame([(1, [5, 0]), (2, [8, 0]), (3, [1, 0])], "example long, label array<int>")
    got = {(r["metric"], r["k"]): r["value"] for r in G.metrics(preds, labels, (1, 2), eos=0).collect()}
    assert got["recall", 1] == 0 and got["recall", 2] == pytest.approx(1 / 3)
    assert got["ndcg", 2] == pytest.approx(1 / np.log2(3) / 3) and got["err", 1] == pytest.approx(1 / 3)
    full = G.padded(preds, labels, 4, 1).groupBy("example").count().collect()
    assert {r["count"] for r in full} == {4}
