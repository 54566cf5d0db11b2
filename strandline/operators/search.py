"""Decoding without a model: what may follow at each step, and beam search over a score function."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.tables import discarded, kept
from strandline.operators.vocabulary import Vocabulary

#: What stands before the first token of a sequence.
START = -1


def step_tokens(vocab: Vocabulary, eos: int, control: Iterable[int] = ()) -> list[list[int]]:
    """Tokens allowed at each step of a target that is spelt in atoms: a slot's atoms in slot order, the control tokens
    one by one, then the end. Nothing may follow."""
    slots: list[list[int]] = [[] for _ in range(vocab.slots)]
    for (slot, _), token in vocab.index.items():
        slots[slot].append(token)
    return [sorted(x) for x in slots] + [[c] for c in control] + [[eos]]


def grammar_table(spark: SparkSession, steps: list[list[int]]) -> DataFrame:
    """(step, token) of step_tokens; bounded by the code books."""
    return spark.createDataFrame([(k, t) for k, ts in enumerate(steps) for t in ts], "step int, token int")


def beam_search(score: Callable[[tuple], dict[int, float]], eos: int, horizon: int, beams: int, returns: int, steps: list[list[int]] | None = None) -> list[tuple[tuple, float]]:
    """The best sequences by the sum of log probabilities, best first, ties by tokens: (tokens, score).

    score gives the log probabilities of what may follow a prefix. A sequence that ends is scored once, leaves the
    beam and is only displaced by better ended ones; the search stops when no live prefix can get better than the ended
    ones that are returned (log probabilities are not positive). At the horizon, prefixes that have not ended fill up what is missing."""
    live: list[tuple[float, tuple]] = [(0.0, ())]
    ended: list[tuple[float, tuple]] = []
    order = lambda x: (-x[0], x[1])
    for k in range(horizon):
        allowed = None if steps is None else set(steps[k]) if k < len(steps) else set()
        grown = []
        for total, prefix in live:
            for token, p in score(prefix).items():
                if p > -math.inf and (allowed is None or token in allowed):
                    (ended if token == eos else grown).append((total + p, (*prefix, token)))
        ended = heapq.nsmallest(returns, ended, key=order)
        live = heapq.nsmallest(beams, grown, key=order)
        if not live or (len(ended) == returns and ended[-1][0] >= live[0][0]):
            break
    best = ended + heapq.nsmallest(returns - len(ended), live, key=order) if len(ended) < returns else ended
    return [(tokens, total) for total, tokens in best]


def constrained(scores: DataFrame, grammar: DataFrame) -> DataFrame:
    """Scores (context, step, prev, token, score) of the tokens that the grammar (step, token) allows, as log probabilities among
    them: what may follow one token in one context adds up to one."""
    here = Window.partitionBy("context", "step", "prev")  # at most a code book
    held = scores.where("score > double('-infinity')").join(grammar.select("step", "token").distinct(), ["step", "token"])
    top = F.max("score").over(here)
    total = held.withColumn("_top", top).withColumn("_sum", F.sum(F.exp(F.col("score") - F.col("_top"))).over(here))
    return total.select("context", "step", "prev", "token", (F.col("score") - F.col("_top") - F.log("_sum")).alias("score"))


def search_table(examples: DataFrame, scores: DataFrame, eos: int, horizon: int, beams: int, returns: int, end_aware: bool = True) -> DataFrame:
    """(example, rank, tokens, score): the best sequences of every example (example, context), all examples at once. scores are log
    probabilities (context, step, prev, token, score) of what may follow a token at a step; START is before the first.

    Each step is a join of the live prefixes with what may follow them, and the ``beams`` best of each example go on. In the
    end-aware form a sequence that ends leaves the beam with its score and competes with the others at last; prefixes that have not
    ended by the horizon still do. In the fixed-length form the end is a token like others, and only what is alive at the
    horizon is returned. Scores are compared to nine digits, ties go by tokens. An example whose context has no
    scores has no rows; repeated examples count once; null contexts and scores match nothing."""
    if horizon < 1 or not 1 <= returns <= beams:
        raise ValueError("a horizon of one at least, and no more returns than beams")

    def best(rows: DataFrame, n: int) -> DataFrame:
        order = Window.partitionBy("example").orderBy(F.desc(F.round("score", 9)), "tokens")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    live = examples.select("example", "context").distinct().select("example", "context", F.array().cast("array<int>").alias("tokens"), F.lit(START).alias("prev"), F.lit(0.0).alias("score"))
    ended, steps = [], []
    for k in range(horizon):
        after = scores.where(F.col("step") == k).select("context", "prev", F.col("token").cast("int").alias("token"), F.col("score").alias("more"))
        grown = live.join(after, ["context", "prev"]).select("example", "context", F.concat("tokens", F.array("token")).alias("tokens"), F.col("token").alias("prev"), (F.col("score") + F.col("more")).alias("score"))
        # ended and live ones both read it
        steps.append(kept(grown if end_aware else best(grown, beams).drop("rank"), "beams"))
        if end_aware:
            ended.append(steps[-1].where(F.col("prev") == eos))
            live = best(steps[-1].where(F.col("prev") != eos), beams).drop("rank")
        else:
            live = steps[-1]
    out = live
    for rows in ended:
        out = out.unionByName(rows)
    result = kept(best(out, returns).select("example", "rank", "tokens", "score"), "found")
    discarded(*steps)
    return result
