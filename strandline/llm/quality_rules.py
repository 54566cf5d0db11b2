"""Quality rules by distribution divergence.

Every document gets a histogram of character classes and, for each reference language, one of that
language's common words. References are the sums of these histograms over all documents of a
language, with partial aggregation; only (languages x bins) numbers reach the driver, and they can be kept as a table
(``references_table``) and used on other documents. A document is rejected if its Jensen-Shannon distance
to the nearest reference is too large, and only histograms that rest on enough characters or words
are compared. Two base rules (too few words, too much repetition) come first.

DataFrame functions only. The texts are read once: counts are written aside, and references and verdicts come from them.

Defined results for odd input: a null text is an empty one, and fails the base rules; a document that names a
language without a reference is not compared with any, only the base rules hold for it; one that names no language
(null, or no such column) is compared with the nearest reference, and adds to none; without any reference nothing
is judged; repeated rows are judged alike; extra columns are kept by ``keep_good`` and may have any
name but those that begin with ``_q_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, text_or_empty

# Frequent function words of the four reference languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with", "as", "are", "by", "this"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
ALL_COMMON = sorted({w for ws in COMMON_WORDS.values() for w in ws})

WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document of n words is rejected above the distance base + slack / sqrt(n): the histogram of a
#: short text strays from its language by chance alone. Below the guards it isn't judged at all.
CHAR_LIMIT = (0.16, 1.1)
WORD_LIMIT = (0.12, 1.6)
MIN_CHARS_JUDGED = 120
MIN_WORDS_JUDGED = 40

#: Character classes, removed one after the other from the text without white space.
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("stop", "[.,;:!?]+"), ("other_ascii", r"[\x00-\x7F]+")]


def _with_words(docs: DataFrame) -> DataFrame:
    text = F.regexp_replace(text_or_empty(), r"[\x09-\x0D]", " ")
    return docs.withColumn("_q_words", F.filter(F.split(text, " "), lambda w: w != ""))


def with_histograms(docs: DataFrame) -> DataFrame:
    """docs with _q_words, _q_n, word_chars, n_symbols, _q_chars (counts by class) and _q_common."""
    df = _with_words(docs)
    df = df.withColumn("_q_n", F.size("_q_words").cast("long")).withColumn("_q_s", F.array_join("_q_words", ""))
    df = df.withColumn("word_chars", F.length("_q_s").cast("long"))
    counts, left = [], "word_chars"
    for name, pattern in CLASSES:
        df = df.withColumn("_q_s", F.regexp_replace("_q_s", pattern, "")).withColumn(f"_q_l_{name}", F.length("_q_s").cast("long"))
        counts.append(F.col(left) - F.col(f"_q_l_{name}"))
        left = f"_q_l_{name}"
    df = df.withColumn("n_symbols", counts[3]).withColumn("_q_chars", F.array(*counts, F.col(left)))
    # only the common words, each between blanks of its own, so that counting one is a replacement
    common = F.filter("_q_words", lambda w: w.isin(ALL_COMMON))
    df = df.withColumn("_q_c", F.concat(F.lit(" "), F.array_join(common, "  "), F.lit(" ")))
    hits = [((F.length("_q_c") - F.length(F.replace(F.col("_q_c"), F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in ALL_COMMON]
    df = df.withColumn("_q_common", F.array(*hits))
    return df.drop("_q_s", "_q_c", *(f"_q_l_{name}" for name, _ in CLASSES))


def _word_bins(common: Column, n: Column, lang: str) -> Column:
    """Counts of the language's common words, and of all other words as the last bin."""
    own = [common[ALL_COMMON.index(w)] for w in COMMON_WORDS[lang]]
    total = own[0]
    for x in own[1:]:
        total = total + x
    return F.array(*own, n - total)


def counted(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """docs (with a text column) with the base rules' columns, _q_chars, _q_common and _q_lang, as a stored table
    without the text, unless that is part of another column."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = with_base(with_histograms(docs.withColumn("_q_lang", lang)))
    return stored(out.drop("_q_words", "text"), "quality-counts")


def references_of(counts: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Shares by language, from the result of counted: of character classes, and of common words. At most
    four short lists are collected."""
    df = counts.where(F.col("_q_lang").isin(list(COMMON_WORDS)) & (F.col("_q_n") >= MIN_WORDS))
    sums = [F.sum(F.col("_q_chars")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    sums += [F.sum(F.col("_q_common")[i]).alias(f"w{i}") for i in range(len(ALL_COMMON))]
    out = {}
    for r in df.groupBy("_q_lang").agg(F.sum("_q_n").alias("n"), *sums).collect():
        lang = r["_q_lang"]
        chars = [float(r[f"c{i}"]) for i in range(len(CLASSES) + 1)]
        own = [float(r[f"w{ALL_COMMON.index(w)}"]) for w in COMMON_WORDS[lang]]
        words = [*own, float(r["n"]) - sum(own)]
        out[lang] = ([x / max(1.0, sum(chars)) for x in chars], [x / max(1.0, sum(words)) for x in words])
    return dict(sorted(out.items()))


def references(docs: DataFrame, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """Shares by language: of character classes, and of common words."""
    return references_of(counted(docs.select("text", lang_col), lang_col))


def references_table(spark: SparkSession, refs: dict) -> DataFrame:
    """References as rows (lang, kind, bin, share), to be written where other runs find them."""
    rows = [(lang, kind, k, float(x)) for lang, both in refs.items() for kind, shares in zip(("chars", "words"), both, strict=True) for k, x in enumerate(shares)]
    return spark.createDataFrame(rows, "lang string, kind string, bin int, share double")


def references_from(table: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """The references of a table written from references_table (a hundred rows)."""
    out: dict = {}
    for r in table.orderBy("lang", "kind", "bin").collect():
        out.setdefault(r["lang"], ([], []))[r["kind"] == "words"].append(r["share"])
    return out


def _js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of counts to shares; 0 for an empty histogram."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def part(c: Column, q: Column) -> Column:
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    twice = F.aggregate(F.zip_with(counts, ref, part), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.sqrt(F.greatest(twice / 2, F.lit(0.0)))).otherwise(0.0)


def with_base(docs: DataFrame) -> DataFrame:
    """docs (with _q_words and _q_n) with n_dup_lines, n_repeat_words and base_failed."""
    lines = F.filter(F.split(text_or_empty(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("_q_lines", lines).withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    # hashes of windows of one, two, four and eight words, each from two of half its size
    df = df.withColumn("_q_w", F.transform("_q_words", lambda w: F.xxhash64(w)))
    for half in (1, 2, 4):
        rest = F.greatest(F.size("_q_w") - half, F.lit(0))
        pairs = F.zip_with(F.slice("_q_w", F.lit(1), rest), F.slice("_q_w", F.lit(half + 1), rest), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("_q_w", pairs)
    # most texts repeat no window, and need no sort
    some = F.size(F.array_distinct("_q_w")) < F.size("_q_w")
    df = df.withColumn("_q_o", F.when(some, F.sort_array(F.transform("_q_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    k = F.sequence(F.lit(0), F.size("_q_o") - 1)
    at = lambda i: F.get(F.col("_q_o"), i)
    again = F.transform(
        k, lambda i: F.when((at(i)["h"] == at(i - 1)["h"]).eqNullSafe(True) | (at(i)["h"] == at(i + 1)["h"]).eqNullSafe(True), at(i)["i"])
    )
    df = df.withColumn("_q_p", F.sort_array(F.array_compact(F.when(F.col("_q_o").isNotNull(), again))))
    # a window covers its eight words, less what the next repeated window covers
    p = lambda i: F.get(F.col("_q_p"), i)
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_q_p") - 1),
        F.lit(0).cast("long"),
        lambda a, i: a + F.least(F.lit(WINDOW_WORDS), F.coalesce(p(i + 1) - p(i), F.lit(WINDOW_WORDS))),
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("_q_p").isNull(), F.lit(0).cast("long")).otherwise(covered))
    failed = (F.col("_q_n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_q_n"))
    return df.withColumn("base_failed", failed).drop("_q_lines", "_q_w", "_q_o", "_q_p")


def with_verdict(df: DataFrame, refs: dict) -> DataFrame:
    """df with char_distance, word_distance (to the nearest reference) and kept."""
    if refs:
        chars = [_js_distance(F.col("_q_chars"), c) for c, _ in refs.values()]
        words = [_js_distance(F.col("_q_bins")[i], w) for i, (_, w) in enumerate(refs.values())]
        df = df.withColumn("_q_bins", F.array(*[_word_bins(F.col("_q_common"), F.col("_q_n"), lang) for lang in refs]))
        df = df.withColumn("char_distance", F.array_min(F.array(*chars))).withColumn("word_distance", F.array_min(F.array(*words)))
    else:
        df = df.withColumn("_q_bins", F.lit(None)).withColumn("char_distance", F.lit(0.0)).withColumn("word_distance", F.lit(0.0))
    limit = lambda base, slack: base + slack / F.sqrt(F.col("_q_n"))
    bad = ((F.col("word_chars") >= MIN_CHARS_JUDGED) & (F.col("char_distance") > limit(*CHAR_LIMIT))) | (
        (F.col("_q_n") >= MIN_WORDS_JUDGED) & (F.col("word_distance") > limit(*WORD_LIMIT))
    )
    unknown = F.col("_q_lang").isNotNull() & ~F.col("_q_lang").isin(list(refs))
    bad = F.coalesce(bad & ~unknown, F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~bad)


def judge(docs: DataFrame, refs: dict | None = None, lang_col: str = "lang") -> DataFrame:
    """The columns of docs but text, and the rules' columns; refs are learned from docs if not given."""
    counts = counted(docs, lang_col)
    return with_verdict(counts, references_of(counts) if refs is None else refs)


def keep_good(docs: DataFrame, refs: dict | None = None, lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs alone."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row")
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return judge(docs.select(row, F.col("text"), lang.alias("_q_own")), refs, "_q_own").where("kept").select("_q_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select(
        "doc_id", F.col("_q_n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance",
    )


ORACLE_SQL = None
