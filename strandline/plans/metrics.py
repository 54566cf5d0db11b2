"""Queries on rankings and token lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import codes as C
from strandline.operators import ranking as G
from strandline.operators.tables import kept
from strandline.plans.inputs import HITS, PREDS, SEQS, predictions, purchases, table

KS = (1, 3, 5)


def first_hits(s, d):
    preds, labels = predictions(s, d)
    return G.first_hits(preds, labels, 99).select("example", F.col("hit").cast("long").alias("hit"))


def ranking_metrics(s, d):
    preds, labels = predictions(s, d)
    return G.metrics(preds, labels, KS, 99).select("metric", F.col("k").cast("long").alias("k"), F.round("value", 8).alias("value"))


def ranking_metrics_by_source(s, d):
    preds, labels = predictions(s, d)
    return G.metrics(preds, labels, KS, 99, "source").select("source", "metric", F.col("k").cast("long").alias("k"), F.round("value", 8).alias("value"))


def allowed_predictions(s, d):
    """Per order, distinct predictions of an allowed set, at most three."""
    preds, _ = predictions(s, d)
    allowed = s.createDataFrame([([a, b],) for a in range(6) for b in range(4) if (a + b) % 2 == 0], "codes array<int>")
    out = G.allowed_only(preds, F.broadcast(allowed), 3, [])
    return out.select("example", F.col("rank").cast("long").alias("rank"), F.array_join("codes", " ").alias("codes"))


def fused_rankings(s, d):
    preds, _ = predictions(s, d)
    out = G.fuse_rankings(preds, 3)
    return out.select("example", F.col("rank").cast("long").alias("rank"), F.array_join("codes", " ").alias("codes"), F.round("score", 6).alias("score"))


def invalid_shares(s, d):
    preds, _ = predictions(s, d)
    return preds.groupBy("member").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get("codes", F.lit(0)) == -1).alias("n_invalid"))


def length_profile(s, d):
    out = G.length_profile(purchases(s, d).groupBy("user").agg(F.count(F.lit(1)).alias("n")), "n")
    return out.select(F.round("mean_length", 6).alias("mean_length"), F.round("p95_length", 6).alias("p95_length"), "max_length", F.round("padding_fraction", 8).alias("padding_fraction"))


def length_gap(s, d):
    p = table(s, d, "part").select((F.col("p_size") % 5 + 1).alias("one"), (F.col("p_size") % 9 + 3).alias("two"))
    out = G.length_gap(p, "one", "two")
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("mean", "median")) else F.col(c).cast("long").alias(c) for c in out.columns])


def padded_inputs(s, d):
    """Sequences between begin and end tokens with a control suffix, padded to the longest, with masks."""
    seqs = purchases(s, d).groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "okey", "line", "item", "supp"))), lambda x: x["item"]).alias("seq"))
    tokens = F.concat(F.array(F.lit(-1).cast("long")), F.col("seq"), C.control_suffix(F.size("seq"), [7, 8]).cast("array<bigint>"), F.array(F.lit(-2).cast("long")))
    rows = kept(seqs.select("user", tokens.alias("t")), "token-rows")
    width = F.lit(rows.agg(F.max(F.size("t"))).first()[0] or 0)  # one number
    return rows.select("user", F.array_join(C.right_padded("t", width), " ").alias("input_ids"), F.aggregate(C.attention_mask("t", width), F.lit(0), lambda a, x: a + x).cast("long").alias("n_tokens"))


def shuffled_sequences(s, d):
    """A repeatable permutation of the whole sequence of each customer."""
    seqs = purchases(s, d).groupBy("user").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "okey", "line", "item", "supp"))), lambda x: x["item"]).alias("seq"))
    return seqs.select("user", F.array_join(C.shuffled("seq", "user"), " ").alias("items"))


QUERIES = {
    f.__name__: f
    for f in (
        first_hits, ranking_metrics, ranking_metrics_by_source, allowed_predictions, fused_rankings, invalid_shares, length_profile, length_gap, padded_inputs, shuffled_sequences,
    )
}

_BAD = f"SELECT example, rank FROM ({PREDS}) WHERE codes[1] = -1"
_METRIC = " UNION ALL ".join(
    f"""SELECT {{0}} 'recall' AS metric, {k} AS k, avg((coalesce(hit, 99) <= {k})::INT) AS value FROM h {{1}}
    UNION ALL SELECT {{0}} 'ndcg', {k}, avg(CASE WHEN hit <= {k} THEN 1 / log2(hit + 1) ELSE 0 END) FROM h {{1}}
    UNION ALL SELECT {{0}} 'err', {k}, avg(coalesce(b{k}, 0) / {k}) FROM h {{1}}"""
    for k in KS
)
_H = f"""WITH h AS (SELECT hits.*, b1, b3, b5 FROM ({HITS}) hits LEFT JOIN (
  SELECT example, count(*) FILTER (rank <= 1) AS b1, count(*) FILTER (rank <= 3) AS b3, count(*) FILTER (rank <= 5) AS b5 FROM ({_BAD}) GROUP BY example) USING (example))"""

SQL = {
    "first_hits": f"SELECT example, hit FROM ({HITS})",
    "ranking_metrics": f"{_H} SELECT metric, k::BIGINT AS k, round(value, 8) AS value FROM ({_METRIC.format('', '')})",
    "ranking_metrics_by_source": f"{_H} SELECT source, metric, k::BIGINT AS k, round(value, 8) AS value FROM ({_METRIC.format('source,', 'GROUP BY source')})",
    "allowed_predictions": f"""
        SELECT example, r AS rank, array_to_string(codes, ' ') AS codes FROM (
          SELECT example, codes, row_number() OVER (PARTITION BY example ORDER BY min(rank)) AS r FROM ({PREDS}) WHERE codes[1] >= 0 AND (codes[1] + codes[2]) % 2 = 0 GROUP BY example, codes)
        WHERE r <= 3""",
    "fused_rankings": f"""
        SELECT example, place AS rank, array_to_string(codes, ' ') AS codes, round(score, 6) AS score FROM (
          SELECT example, codes, sum(1 / log2(rank + 1)) AS score,
            row_number() OVER (PARTITION BY example ORDER BY round(sum(1 / log2(rank + 1)), 12) DESC, min((member, rank))) AS place
          FROM (SELECT example, member, codes, min(rank) AS rank FROM ({PREDS}) WHERE codes[1] <> -1 GROUP BY ALL) GROUP BY example, codes) WHERE place <= 3""",
    "invalid_shares": f"SELECT member, count(*) AS n, count(*) FILTER (codes[1] = -1) AS n_invalid FROM ({PREDS}) GROUP BY member",
    "length_profile": f"""
        SELECT round(avg(n), 6) AS mean_length, round(quantile_cont(n, 0.95), 6) AS p95_length, max(n) AS max_length, round(1 - sum(n) / (max(n) * count(*)), 8) AS padding_fraction
        FROM (SELECT len(seq) AS n FROM ({SEQS}))""",
    "length_gap": """
        SELECT round(avg(one), 6) AS one_mean, round(median(one), 6) AS one_median, min(one)::BIGINT AS one_min, max(one)::BIGINT AS one_max,
          round(avg(two), 6) AS two_mean, round(median(two), 6) AS two_median, min(two)::BIGINT AS two_min, max(two)::BIGINT AS two_max, round_even(avg(two) - avg(one), 0)::BIGINT AS gap
        FROM (SELECT p_size % 5 + 1 AS one, p_size % 9 + 3 AS two FROM part)""",
    "padded_inputs": f"""
        WITH r AS (SELECT user, [-1] || seq || flatten(list_transform(range(len(seq)), lambda x: [7, 8])) || [-2] AS t FROM ({SEQS}))
        SELECT user, array_to_string(t || list_transform(range((SELECT max(len(t)) FROM r) - len(t)), lambda x: 0), ' ') AS input_ids, len(t) AS n_tokens FROM r""",
    "shuffled_sequences": f"""
        SELECT user, string_agg(item, ' ' ORDER BY md5('2024|' || user || '|' || i || '|' || item), i) AS items FROM (
          SELECT user, unnest(seq) AS item, generate_subscripts(seq, 1) - 1 AS i FROM ({SEQS})) GROUP BY user""",
}
