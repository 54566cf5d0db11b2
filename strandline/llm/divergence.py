"""Audit of how far the sources of a language diverge in the terms they use.

Terms are runs of letters of any script but ASCII's other characters, with A-Z in lower case. Two passes:

1. Every task counts, by language, in how many of its documents a term stands, and hands on these partial counts with
   the number of its split. Their sums are exact document frequencies, and the terms of at least MIN_DOCS documents of a
   language are kept. The counts of a term meet once: there they get their sum and, as the term's number, the least of their own.
2. The texts go to one task a split together with the kept terms that this split has (found in the first pass, so
   an automaton grows with a split and not with the vocabulary of the corpus). An Aho-Corasick automaton of the terms, each
   padded with a blank on both sides, runs over the texts, in which every delimiter is a blank, and counts occurrences.

What comes out are sparse postings (a term's number, the sources that have it with their counts); the terms themselves come
back to the few that are ranked highest. For a pair of sources most
kept terms stand in neither or in one of the two, so their sum is made of three parts: terms that both have, from the
postings; terms that only one has, from the histogram of that source's counts; and terms that neither has, which all weigh the
same. Everything is integer arithmetic.

Defined results for odd input: a null text, language or source counts as an empty one; a text without terms still makes its
group occur; a language without kept terms gives its pairs the value 0 and no terms; repeated rows count each; ties go
by the UTF-8 order of items; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, read, repeatable, stored

MIN_DOCS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Counts below this one times SCALE fit a long.
MOST_SMALL = 9_000_000_000
#: Terms that a task holds before it hands on what it has counted, and characters that go through the automaton at once.
HELD_TERMS, CHUNK = 400_000, 1_000_000
#: Bytes that are part of a term as they are in UTF-8, upper case in lower case; all others are blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plain(docs: DataFrame) -> DataFrame:
    """split, lang, source and text (as UTF-8) of every row; split is where a row lies in the scan."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.spark_partition_id().alias("split"), empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("text"))


def _frequencies(batches):
    """split, lang, text -> split, lang, term, number of documents, number of the row. A task has one split, and terms come in
    the order of the texts, so a row has its number whenever it is made."""
    counts: dict = defaultdict(Counter)
    held = made = 0

    def rows():
        nonlocal made
        for (split, lang), terms in counts.items():
            n = len(terms)
            term = pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())
            cols = [pa.repeat(pa.scalar(split, pa.int32()), n), pa.repeat(pa.scalar(lang, pa.string()), n), term, pa.array(list(terms.values()), pa.int64()), pa.array(np.arange(made, made + n) + (split << 36))]
            made += n
            yield pa.RecordBatch.from_arrays(cols, names=["split", "lang", "term", "n", "row"])

    for batch in batches:
        for split, lang, text in zip(*(batch[c].to_pylist() for c in ("split", "lang", "text")), strict=True):
            own = counts[split, lang]
            held -= len(own)
            own.update(dict.fromkeys(text.translate(TABLE).split()).keys())
            held += len(own)
            if held > HELD_TERMS:
                yield from rows()
                counts.clear()
                held = 0
    yield from rows()


def _occurrences(batches):
    """Rows of one split and language after the other, first its terms, then its texts by source -> lang, source, id (of a
    term), n."""
    import ahocorasick

    key, terms, ids, found, counts, source, chunk, size = None, [], [], None, None, None, [], 0

    def search():
        text = " " + " ".join(chunk) + " "
        hits = np.fromiter(map(itemgetter(1), found.iter(text)), np.int64)
        counts[:] += np.bincount(hits, minlength=len(counts))

    def close():
        if chunk:
            search()
        some = np.flatnonzero(counts)
        n = len(some)
        cols = [pa.repeat(pa.scalar(key[1], pa.string()), n), pa.repeat(pa.scalar(source, pa.string()), n), pa.array(ids[some]), pa.array(counts[some], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["lang", "source", "id", "n"])

    for batch in batches:
        for split, lang, of, text, term, number in zip(*(batch[c].to_pylist() for c in ("split", "lang", "source", "text", "term", "id")), strict=True):
            if (split, lang) != key:
                if source is not None:
                    yield close()
                key, terms, ids, found, source, chunk, size = (split, lang), [], [], None, None, [], 0
            if term is not None:
                # a term that the first pass handed on twice keeps its last place, and the other counts nothing
                terms.append(term)
                ids.append(number)
                continue
            if not terms:
                continue  # nothing of this language is kept
            if found is None:
                found = ahocorasick.Automaton()
                for k, t in enumerate(terms):
                    found.add_word(f" {t} ", k)
                found.make_automaton()
                ids = np.array(ids, np.int64)
            if of != source:
                if source is not None:
                    yield close()
                source, counts, chunk, size = of, np.zeros(len(terms), np.int64), [], 0
            # white space of other scripts is part of a term: only blanks part them
            chunk.append(text.translate(TABLE).decode("utf-8", "replace"))
            size += len(text)
            if size > CHUNK:
                search()
                chunk, size = [], 0
    if source is not None:
        yield close()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """First pass: split, lang, term, id of the kept terms that a split has, as a written table; named is true on one row of a
    term. docs must give the same splits whenever it is read (see ``repeatable``)."""
    parts = _plain(docs).select("split", "lang", "text").mapInArrow(_frequencies, "split int, lang string, term string, n long, row long")
    # a term has as many rows as there are splits at most; terms come first, as a sort looks at the first column most
    of_term = Window.partitionBy("term", "lang")
    met = parts.withColumn("n_docs", F.sum("n").over(of_term)).withColumn("id", F.min("row").over(of_term))
    return stored(met.where(F.col("n_docs") >= min_docs).select("split", "lang", "term", "id", (F.col("row") == F.col("id")).alias("named")), "split-terms")


def term_counts(docs: DataFrame, own: DataFrame) -> DataFrame:
    """Second pass: lang, source, id, n (occurrences) of the kept terms, as a written table."""
    kinds = "split int, lang string, source string, text binary, term string, id long"
    none = F.lit(None)
    texts = _plain(docs).withColumns({"term": none.cast("string"), "id": none.cast("long")})
    terms = own.select("split", "lang", none.cast("string").alias("source"), none.cast("binary").alias("text"), "term", "id")
    rows = terms.unionByName(texts).to(StructType.fromDDL(kinds)).repartition("split").sortWithinPartitions("split", "lang", F.col("source").asc_nulls_first())
    counted = rows.mapInArrow(_occurrences, "lang string, source string, id long, n long")
    # within a split nothing is left to sum up, so rows are dealt before they are
    return stored(counted.repartition("id").groupBy("id", "lang", "source").agg(F.sum("n").alias("n")), "term-counts")


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact for counts of any size; those that fit a long are divided as such."""
    wide = lambda c: c.cast("decimal(20,0)")
    small = F.call_function("div", (n + 2) * F.lit(SCALE).cast("long"), total + 2 * v)
    large = F.call_function("div", wide(n + 2) * F.lit(SCALE).cast("decimal(11,0)"), wide(total + 2 * v))
    return F.when(v > 0, F.when(n < MOST_SMALL, small).otherwise(large) + 1)


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def group_stats(docs: DataFrame, own: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gid (a number of its own), lang, source, total (occurrences of kept terms), n_terms (that it has), v (kept terms of the
    language), p0 (the share of a term that it lacks), lang_total of every group; and gid, p, terms: how many of its terms
    have one share. Both are written tables."""
    spark = docs.sparkSession
    groups = _plain(docs).select("lang", "source").distinct()
    equal = stored(counts.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "equal-counts")
    sums = equal.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"), F.sum("terms").alias("n_terms"))
    size = own.where("named").groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    known = groups.join(sums, ["lang", "source"], "left").join(size, "lang", "left").select("lang", "source", zero("total"), zero("n_terms"), zero("v"))
    whole = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = known.join(whole, "lang", "left").withColumn("p0", _share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    stats = stored(known.withColumn("gid", F.monotonically_increasing_id()), "group-stats")
    shares = equal.join(stats, ["lang", "source"]).select("gid", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "terms")
    histogram = stored(shares, "equal-shares")
    discard(spark, equal)
    return stats, histogram


def postings(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """id, q (the share of the term in its language), posts (gid, p, p0 of the groups that have it), as a written table."""
    of_group = stats.select("lang", "source", "gid", "total", "v", "lang_total", "p0")
    shares = counts.join(of_group, ["lang", "source"]).select("id", "lang_total", "v", "n", "gid", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), "p0")
    met = shares.repartition("id").groupBy("id", "lang_total", "v").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("gid", "p", "p0"))).alias("posts"))
    return stored(met.select("id", _share(F.col("n"), F.col("lang_total"), F.col("v")).alias("q"), "posts"), "postings")


def term_gaps(posts: DataFrame) -> DataFrame:
    """gid, id, value of the terms that a group has and uses more than its language: p > q."""
    each = posts.select("id", "q", F.explode("posts").alias("x")).where(F.col("x.p") > F.col("q"))
    return each.select(F.col("x.gid").alias("gid"), "id", _gap(F.col("x.p"), F.col("q")).alias("value"))


def top_terms_of(posts: DataFrame, stats: DataFrame, own: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value, rank of the terms with the highest gaps, as a written table. Terms get their text when those
    are left that any order of ties could rank."""
    by_value = Window.partitionBy("gid").orderBy(F.desc("value"))
    left = term_gaps(posts).withColumn("place", F.rank().over(by_value)).where(F.col("place") <= top).drop("place")
    named = left.join(own.where("named").select("id", F.col("term").alias("item")), "id")
    ranked = named.withColumn("rank", F.row_number().over(by_value.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)
    return stored(ranked.join(stats.select("gid", "lang", "source"), "gid").select("lang", "source", "item", "value", "rank"), "top-terms")


def pair_gaps(posts: DataFrame, stats: DataFrame, histogram: DataFrame) -> DataFrame:
    """lang, source, other, value for every pair of sources of a language, once, as a written table. The result grows with the
    square of the sources of a language, as it is asked for; the sums over terms are made of postings and histograms."""
    # terms that both have: every posting meets those behind it in its term's list
    first = posts.select("posts", F.posexplode("posts").alias("k", "x")).select("x", F.explode(F.slice("posts", F.col("k") + 2, F.size("posts"))).alias("y"))
    p, p0, q, q0 = F.col("x.p"), F.col("x.p0"), F.col("y.p"), F.col("y.p0")
    more = _gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0)
    shared = first.groupBy(F.col("x.gid").alias("gid"), F.col("y.gid").alias("other")).agg(F.sum(more).alias("value"))
    # terms of one side against a term that the other lacks: equal shares are counted first
    ends = stats.select("lang", "gid", "p0", "v", "n_terms")
    other = ends.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"), F.col("n_terms").alias("other_terms"))
    # one row for each pair and direction; dealt anew, as there are few languages
    pairs = stored(ends.join(other, "lang").where("gid != other").drop("lang").repartition("gid", "other"), "source-pairs")
    ordered = lambda f: getattr(F, f)("gid", "other")
    single = pairs.select("gid", "other", "q0").join(histogram, "gid")
    single = single.groupBy(ordered("least").alias("gid"), ordered("greatest").alias("other")).agg(F.sum(_gap(F.col("p"), F.col("q0")) * F.col("terms")).alias("value"))
    neither = pairs.where("gid < other").select("gid", "other", F.coalesce((F.col("v") - F.col("n_terms") - F.col("other_terms")) * _gap(F.col("p0"), F.col("q0")), F.lit(0).cast("long")).alias("value"))
    gaps = neither.unionByName(single).unionByName(shared).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    names = stats.select("gid", "lang", "source")
    gaps = gaps.join(names, "gid").join(names.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")
    return stored(gaps.select("lang", "source", F.col("item").alias("other"), "value"), "source-gaps")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of every group by how far they are from it (part pair),
    and the terms that set the group most apart from its language (part term)."""
    spark = docs.sparkSession
    docs = repeatable(docs.select("text", "lang", "source"))
    own = kept_terms(docs, min_docs)
    counts = term_counts(docs, own)
    stats, histogram = group_stats(docs, own, counts)
    posts = postings(counts, stats)
    discard(spark, counts)
    top = top_terms_of(posts, stats, own, top_terms)
    discard(spark, own)
    gaps = pair_gaps(posts, stats, histogram)
    discard(spark, posts, histogram, stats)
    turned = gaps.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = gaps.unionByName(turned).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


_SHARE = "1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {v})"
_GAP = "((p - q) * (p - q)) // (p + q)"
ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
flat AS (SELECT row, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM flat GROUP BY ALL HAVING count(DISTINCT row) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM flat SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
lang_totals AS (SELECT lang, sum(total) AS total FROM totals GROUP BY ALL),
shares AS (SELECT lang, source, term, n, {_SHARE.format(n="n", total="total", v="v")} AS p FROM dense JOIN totals USING (lang, source) JOIN size USING (lang)),
lang_shares AS (SELECT lang, term, {_SHARE.format(n="sum(n)", total="any_value(total)", v="any_value(v)")} AS q FROM dense JOIN lang_totals USING (lang) JOIN size USING (lang) GROUP BY lang, term),
pairs AS (SELECT lang, source, item, coalesce(value, 0) AS value FROM (SELECT x.lang, x.source, y.source AS item FROM groups x JOIN groups y ON x.lang = y.lang AND x.source != y.source)
  LEFT JOIN (SELECT lang, source, item, sum({_GAP}) AS value FROM (SELECT x.lang, x.source, y.source AS item, x.p, y.p AS q FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source) GROUP BY ALL)
  USING (lang, source, item)),
terms AS (SELECT lang, source, term AS item, {_GAP} AS value FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 10
"""
