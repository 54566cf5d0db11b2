"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to (their membership pattern). A flow
network routes words from patterns to source quotas: a pattern offers its words once for nothing,
a second time at a price, and so on, so that repetition is used only where a quota needs it. The
network has one node per pattern and per source, so it is solved on the driver, by connected parts: a source
whose documents have no other source needs no flow at all. The tally of patterns that the driver holds is bounded by
``max_patterns`` (a few hundred bytes each) and checked. Documents are then selected in a seeded order: a distributed prefix
sum over hash ranges, in two levels, finds where each quota ends, so no source (hot or not) is ever
sorted in one task.

Defined results for odd input: a null text has no words; a null source is a source of its own,
ordered last; documents of no words take nothing; rows that repeat are rows of their own; a table
without words gives targets of 0; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import WORD, fresh, read, stored, text_or_empty

RANGES = 1024  # hash ranges of each of the two levels


def source_targets(sizes: dict, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by source: share * all words by repeating weights, none above most * its own words.

    sizes: words by source; None is the null source. What a cap cuts off is shared again by weight
    until no source is above its cap.
    """
    order = sorted(s for s in sizes if s is not None)  # strings are ordered by code point
    order += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), share * sum(sizes.values())
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            target |= {s: weight[s] * unit for s in open_}
            break
        target |= {s: most * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


class Flow:
    """Largest flow by blocking flows (Dinic), for real capacities; capacities may be added between runs."""

    def __init__(self, nodes: int):
        self.graph: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, room: float) -> int:
        k = len(self.to)
        for x, y, r in ((a, b, room), (b, a, 0.0)):
            self.graph[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return k

    def _levels(self, s: int, eps: float) -> list[int]:
        level = [-1] * len(self.graph)
        level[s], queue = 0, [s]
        for a in queue:
            for k in self.graph[a]:
                if self.room[k] > eps and level[self.to[k]] < 0:
                    level[self.to[k]] = level[a] + 1
                    queue.append(self.to[k])
        return level

    def run(self, s: int, t: int, eps: float = 1e-6) -> None:
        while (level := self._levels(s, eps))[t] >= 0:
            turn = [0] * len(self.graph)  # edges before it lead nowhere any more
            path: list[int] = []
            at = s
            while True:
                if at == t:
                    flow = min(self.room[k] for k in path)
                    for k in path:
                        self.room[k] -= flow
                        self.room[k ^ 1] += flow
                    first = next(i for i, k in enumerate(path) if self.room[k] <= eps)
                    at = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                edges = self.graph[at]
                while turn[at] < len(edges):
                    k = edges[turn[at]]
                    if self.room[k] > eps and level[self.to[k]] == level[at] + 1:
                        break
                    turn[at] += 1
                if turn[at] < len(edges):
                    path.append(edges[turn[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def _parts(patterns: dict[tuple, int]) -> list[list[tuple]]:
    """Patterns by connected part: those that share sources, directly or through others."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for p in patterns:
        for s in p[1:]:
            up[root(s)] = root(p[0])
    parts: dict = defaultdict(list)
    for p in patterns:
        parts[root(p[0])].append(p)
    return list(parts.values())


def route(patterns: dict[tuple, int], targets: dict, repeats: int = 2) -> dict[tuple, float]:
    """Words to take of each pattern: the flow of least cost that fills the targets as far as possible.

    The r-th use of a pattern's words costs r * r, a convex price, so a pattern is repeated only
    after every pattern that can serve the same quota has been used up once. Only edges out of the start bear a price,
    and no augmenting path passes the start twice, so paths of least cost are those by the cheapest use that
    is left: the flow of least cost is the largest one over first uses, then augmented over second uses, and so on.
    """
    out: dict[tuple, float] = {}
    for part in _parts(patterns):
        names = list(dict.fromkeys(s for p in part for s in p))
        at = {s: 2 + i for i, s in enumerate(names)}
        net = Flow(2 + len(names) + len(part))
        for s in names:
            net.edge(at[s], 1, float(targets[s]))
        supply = {}
        for j, p in enumerate(part, 2 + len(names)):
            supply[p] = net.edge(0, j, 0.0)
            for s in p:
                net.edge(j, at[s], float(repeats * patterns[p]))
        for _ in range(repeats):
            for p, k in supply.items():
                net.room[k] += float(patterns[p])
            net.run(0, 1)
        out |= {p: net.room[k ^ 1] for p, k in supply.items()}
    return out


def _memberships(docs: DataFrame, sources: str) -> DataFrame:
    """docs with pattern: the sorted distinct sources of a document, null last as one more source."""
    kind = docs.schema[sources].dataType
    many = F.col(sources) if isinstance(kind, T.ArrayType) else F.array(F.col(sources))
    many = F.when(many.isNull() | (F.size(many) == 0), F.array(F.lit(None).cast("string"))).otherwise(many)
    return docs.withColumn("pattern", F.sort_array(F.array_distinct(F.transform(many, lambda x: x.cast("string")))))


def mix(docs: DataFrame, sources: str = "source", weights=(5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 17, max_patterns: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, size, pattern, source_size, target, taken, text_hash.

    sources names a string column or an array of strings. For a document in several sources,
    source_size and target are those of its first source. taken is at most repeats * size: whole
    passes over the document, and for one document of each pattern a partial pass, at which the
    pattern's quota is met to the word.
    """
    spark = docs.sparkSession
    rows = _memberships(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text_or_empty()).alias("text_hash"),
            F.col(sources).alias("_sources"),
        ),
        "_sources",
    ).drop("_sources")
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
    rows = rows.withColumn("_hi", F.shiftrightunsigned("_h", 54)).withColumn("_lo", F.shiftrightunsigned("_h", 44).bitwiseAND(1023))
    rows = stored(rows, "mix-sizes")
    tally = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(max_patterns + 1).collect()
    if len(tally) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    # sorted: flows of equal cost must not depend on the order in which the tally comes
    patterns = dict(sorted(((tuple(r["pattern"]), int(r["words"])) for r in tally), key=lambda x: [(s is None, s or "") for s in x[0]]))
    by_source: dict = defaultdict(int)
    for p, words in patterns.items():
        for s in p:
            by_source[s] += words
    # overlapping words would be counted for each of their sources
    whole = sum(patterns.values()) or 1
    targets = source_targets(dict(by_source), weights, share * whole / (sum(by_source.values()) or 1), float(repeats))
    quota = route(patterns, targets, repeats)
    plan = spark.createDataFrame(
        [(list(p), float(quota[p]), int(by_source[first]), float(targets[first])) for p in patterns for first in [next((s for s in p if s is not None), None)]],
        "pattern array<string>, quota double, source_size long, target double",
    )
    return _select(rows, plan, repeats)


def _select(rows: DataFrame, plan: DataFrame, repeats: int) -> DataFrame:
    """Seeded selection. A pattern's quota q over its words w is q div w whole passes and a rest;
    the rest goes to the documents that come first by hash, ended to the word.

    A prefix sum over RANGES hash ranges of each pattern tells which range the rest ends in; the
    same again inside that range; only documents of the last sub-range (about one in RANGES ** 2)
    are ordered by a window. The tables of ranges hold at most patterns * RANGES rows.
    """
    key = ["pattern"]
    first = _ends(rows.groupBy(*key, "_hi").agg(F.sum("size").alias("w")), plan, "_hi")
    first = stored(first, "mix-ranges")
    cut = first.where("w_before <= rest and rest < w_before + w").select(*key, "_hi", "rest", "w_before")
    sub = rows.join(cut, [*key, "_hi"])
    second = sub.groupBy(*key, "_hi", "_lo").agg(F.sum("size").alias("w"), F.max("rest").alias("rest"), F.max("w_before").alias("start"))
    w2 = Window.partitionBy(*key, "_hi").orderBy("_lo")
    second = second.withColumn("w_before", F.col("start") + F.sum("w").over(w2) - F.col("w"))
    second = stored(second.select(*key, "_hi", "_lo", "w", "rest", "w_before"), "mix-subranges")
    out = rows.join(first.select(*key, "_hi", "passes", "rest", "source_size", "target", F.col("w_before").alias("b1"), F.col("w").alias("w1")), [*key, "_hi"])
    out = out.join(second.select(*key, "_hi", "_lo", F.col("w_before").alias("b2"), F.col("w").alias("w2")), [*key, "_hi", "_lo"], "left")
    out = out.withColumn("_b", F.coalesce("b2", "b1")).withColumn("_w", F.coalesce("w2", "w1"))
    out = out.withColumn("_in", F.col("b2").isNotNull() & (F.col("_b") <= F.col("rest")) & (F.col("rest") < F.col("_b") + F.col("_w")))
    sure = out.where("not _in").withColumn("_extra", F.when(F.col("_b") + F.col("_w") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    last = Window.partitionBy(*key, "_hi", "_lo").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = out.where("_in").withColumn("_before", F.col("_b") + F.coalesce(F.sum("size").over(last), F.lit(0)))
    edge = edge.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_before")))).drop("_before")
    both = sure.select(*edge.columns).unionByName(edge)
    taken = F.least(F.col("passes") * F.col("size") + F.col("_extra"), F.lit(repeats) * F.col("size"))
    return both.select("doc_id", "size", "pattern", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def _ends(ranges: DataFrame, plan: DataFrame, by: str) -> DataFrame:
    """ranges with the words before each of them and the pattern's quota as whole passes and a rest."""
    w = Window.partitionBy("pattern").orderBy(by)
    every = Window.partitionBy("pattern")
    out = ranges.withColumn("w_before", F.sum("w").over(w) - F.col("w")).withColumn("all", F.sum("w").over(every))
    out = out.join(plan, "pattern")  # broadcast by its size alone, which Spark knows
    out = out.withColumn("q", F.round("quota").cast("long"))
    passes = F.when(F.col("all") > 0, F.expr("q div all")).otherwise(F.lit(0)).cast("long")
    return out.withColumn("passes", passes).withColumn("rest", F.col("q") - F.col("passes") * F.col("all")).drop("q", "quota", "all")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, to whole passes: a pass over at least half of a
    document counts. Rows equal in doc_id and text share what is taken of them alike."""
    passes = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    plan = mix(docs, **options).select("doc_id", "text_hash", passes.cast("int").alias("passes"))
    mix_id, mix_hash, times, turn = (fresh(docs, x) for x in ("_mix_id", "_mix_hash", "_mix_passes", "_mix_pass"))
    plan = plan.groupBy(F.col("doc_id").alias(mix_id), F.col("text_hash").alias(mix_hash)).agg(F.floor(F.avg("passes") + 0.5).cast("int").alias(times))
    plan = plan.where(F.col(times) > 0)
    same = (F.xxhash64(text_or_empty()) == F.col(mix_hash)) & F.col("doc_id").cast("long").eqNullSafe(F.col(mix_id))
    many = docs.join(plan, same).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = None
