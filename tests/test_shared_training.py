"""Queries on one vocabulary: the users' sequences are made once a query, and the training is that of blocks."""

from strandline.operators import training as R
from strandline.operators import vocabulary as M
from strandline.plans import merging

SF = "/root/testdata/sf0.001"


def test_path_queries_train_without_chains(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("a chain for a single sequence")

    monkeypatch.setattr(M.Chain, "__init__", fail)
    assert not hasattr(R, "Chain")
    assert sum(r["n"] for r in merging.merge_path_stages(spark, SF).collect()) > 0


def test_history_policies_count_every_item(spark):
    rows = {r["policy"]: r["n"] for r in merging.history_policies(spark, SF).collect()}
    assert set(rows) == {"raw", "full", "middle", "random"} and len(set(rows.values())) == 1


def test_a_training_that_is_there_is_found_without_sequences(spark, monkeypatch):
    """The users' sequences are a join of all purchases; who reads a vocabulary alone does not make them again."""
    merging.trained_merges(spark, SF)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("found", "found")
    try:
        monkeypatch.setattr(merging, "kept", None)
        vocab, log, rows = merging._trained(spark, SF)
        assert len(vocab.rules) == log.count() and rows.columns == ["user", "feats"]
        assert len(jobs.getJobIdsForGroup("found")) < 20
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_sequences_are_read_as_blocks(spark):
    """A row of the trainer's table holds many sequences, which go to a task as bytes and not item by item."""
    seqs = spark.createDataFrame([([[k % 3, k % 2]] * (1 + k % 4),) for k in range(300)], "feats array<array<int>>").coalesce(1)
    trainer = R.TableTrainer(seqs)
    blocks = trainer.sequences.collect()
    assert len(blocks) < trainer.n_sequences and trainer.n_rows == 300
    assert sum(len(r["n"]) // 8 for r in blocks) == trainer.n_sequences and {f.dataType.typeName() for f in trainer.sequences.schema} == {"binary"}
    trainer.close()
