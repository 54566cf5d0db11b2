"""URL filters by rules that are indexed by their rarest literal token.

A rule is text in one of two forms. ``net/es/`` is a host and a path: it fits the host and all its subdomains where the
path begins so. Anything that begins with ``~`` is a pattern over host and path, in which ``*`` stands for any
characters and ``^`` for a separator (an ASCII character that is neither letter nor digit, or an end). Both become a regular
expression and the list of their literal tokens: runs of letters and digits that a matching URL is sure to have as whole
tokens. How often tokens of rules occur in the URLs is counted, each rule is entered under its rarest token,
and the tokens of a URL fetch its candidate rules by a join; only those run their regular expression. A rule without a
literal token is entered under the empty token, which every URL has.

Of the rules that fit, those of host and path go before patterns, then the longest wins, then the first by its text. The
index is broadcast where it has at most BROADCAST_RULES rules of BROADCAST_BYTES in all; else the join is a shuffle, in
which a common token is split over SALTS keys. Everything runs in the JVM. The URLs' side has one row for each distinct token of
a URL, and is summed up to one row a URL before it is shuffled.

Defined results for odd input: a null URL, or one without ``://``, has an empty host and path, which no rule fits: it
is allowed; repeated rows are judged each; a URL may be of any length; only A-Z are lower-cased, and a port or a user belongs to
the host as it stands there; extra columns are ignored; an empty table gives an empty result, and without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, repeatable, stored

BROADCAST_RULES, BROADCAST_BYTES, SALTS = 100_000, 16 << 20, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A token is a run of these, a separator is anything else.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Rules of the query. Fixed values.
HOST_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Our own patterns for what no such rule fits: betting, pills, adult pages, link farms, advertising, files that are no pages.
PATTERNS = [
    ("~^casino^", "block"), ("~^poker^", "block"), ("~^bets^", "block"), ("~^betting^", "block"), ("~^jackpot^", "block"),
    ("~^pills^", "block"), ("~^viagra^", "block"), ("~^porn*", "block"), ("~^xxx^", "block"), ("~^adult^", "block"), ("~^adult^education^", "allow"),
    ("~^spam^farm^", "block"), ("~^link^farm^", "block"), ("~^ads^track^", "block"), ("~^adserver^", "block"), ("~^banner^ads^", "block"),
    ("~^wp^login^php^", "block"), ("~*.exe", "block"), ("~*.zip", "block"), ("~*.apk", "block"),
]


def parts_of(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty without ://."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def tokens_of(text: Column) -> Column:
    """The distinct tokens of a text, A-Z in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TOKEN), F.lit(0)))


def compiled(rules: DataFrame) -> DataFrame:
    """rule, verdict -> rule, verdict, is_host, size, regex and literals of every rule, equal rules once."""
    text = F.col("rule")
    quoted = lambda c, marks: F.regexp_replace(c, rf"([\\.\[\](){{}}+?$|{marks}])", r"\\$1")
    host, path = F.substring_index(text, "/", 1), F.regexp_extract(text, r"(?s)^[^/]*(.*)$", 1)
    host_regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(F.translate(host, UPPER, LOWER), "*^"), F.lit(r"(?=/|\z)"), quoted(path, "*^"))
    # a host stands whole between dots; the last run of letters of a path may go on in a URL
    host_tokens = F.array_union(tokens_of(host), tokens_of(F.regexp_extract(path, "(?s)^(.*)" + SEPARATOR, 1)))
    body = F.regexp_extract(text, r"(?s)^~(.*)$", 1)
    # between stars the first place that fits is as good as any later one, so nothing is tried twice: time is linear in the URL
    separator = r"(?:^|\\z|" + SEPARATOR.replace("\\", "\\\\") + ")"
    pieces = F.regexp_replace(F.regexp_replace(quoted(body, ""), r"^\*+|\*+$", ""), r"\*+", "*")
    regex = F.concat(F.lit("(?s)^(?>.*?"), F.replace(F.regexp_replace(pieces, r"\^", separator), F.lit("*"), F.lit(")(?>.*?")), F.lit(")"))
    # a run is a whole token between two separators; beside a star, or where the pattern begins or ends, it may go on
    inner = F.regexp_replace(body, f"^{TOKEN}|{TOKEN}$", "*")
    beside = SEPARATOR.replace(r"\x2F", r"\x29\x2B-\x2F", 1)  # all separators but the star
    literals = F.regexp_extract_all(inner, F.lit(f"(?<={beside}){TOKEN}(?={beside})"), F.lit(0))
    is_host = ~text.startswith("~")
    out = rules.where("rule is not null and verdict is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))
    return out.select(
        "rule", "verdict", is_host.alias("is_host"), F.length("rule").alias("size"), F.when(is_host, host_regex).otherwise(regex).alias("regex"),
        F.when(is_host, host_tokens).otherwise(F.array_distinct(F.transform(literals, lambda t: F.translate(t, UPPER, LOWER)))).alias("literals"),
    )


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Every rule under the rarest of its literal tokens, by how many URLs have it (the first by its bytes of equals); under
    the empty token if it has none. urls: a column ``tokens``."""
    literals = rules.select("rule", F.explode("literals").alias("token"))
    # counted before the join, so that a common token is one row of each task
    counts = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = literals.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")), "token"))["token"].alias("token"))
    return rules.drop("literals").join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judged(pages: DataFrame, rules: DataFrame, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """page_id, host, path, rule (of host and path, null if none fits), pattern (if one decides) and verdict of every row."""
    spark = pages.sparkSession
    host, path = parts_of(F.col("url"))
    rows = repeatable(pages.select("page_id", "url")).select("page_id", host.alias("host"), path.alias("path"))
    subject = F.concat("host", "path")
    rows = rows.select("page_id", "host", "path", F.concat(F.array(F.lit("")), tokens_of(subject)).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    index = stored(indexed(compiled(rules), rows), "url-rules")
    n, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("regex") + F.length("rule") + 64), F.lit(0))).first()
    flat = rows.select("page_id", "host", "path", "row", F.explode("tokens").alias("token"))
    if n <= broadcast_rules and size <= BROADCAST_BYTES:
        found = flat.join(F.broadcast(index), "token", "left")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = flat.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left")
    fits = F.expr("regex is not null and rlike(concat(host, path), regex)")
    found = found.where((F.col("token") == "") | fits)  # the empty token keeps every URL
    # host rules first, then the longest, then the first by its text: the order of a struct minimum
    best = F.min(F.when(fits, F.struct((~F.col("is_host")).alias("pattern"), (-F.col("size")).alias("size"), "rule", "verdict")))
    out = found.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return out.select(
        "page_id", "host", "path", F.when(~F.col("best.pattern"), F.col("best.rule")).alias("rule"), F.when(F.col("best.pattern"), F.col("best.rule")).alias("pattern"),
        F.coalesce("best.verdict", F.lit("allow")).alias("verdict"),
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = HOST_RULES + PATTERNS) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"), rules_table(spark))


def _sql_rules() -> str:
    """Host rules by hand, patterns as regular expressions of RE2."""
    own = SEPARATOR
    rows = [f"('{r}', '{v}', true, '{r.split('/')[0]}', '{r[len(r.split('/')[0]) :]}', '')" for r, v in HOST_RULES]
    for r, v in PATTERNS:
        regex = r[1:].replace(".", "[.]").replace("*", ".*").replace("^", f"(?:{own}|^|$)")
        rows.append(f"('{r}', '{v}', false, '', '', '(?s){regex}')")
    return ", ".join(rows)


ORACLE_SQL = rf"""
WITH rules(rule, verdict, is_host, h, p, regex) AS (VALUES {_sql_rules()}),
cut AS (SELECT row_number() OVER () AS row, page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) AS x FROM pages),
u AS (SELECT row, page_id, translate(x.host, '{UPPER}', '{LOWER}') AS host, x.path AS path FROM cut),
fits AS (
  SELECT u.row, r.* FROM u JOIN rules r ON CASE WHEN is_host THEN (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) ELSE regexp_matches(u.host || u.path, r.regex) END),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY is_host DESC, length(rule) DESC, rule) AS k FROM fits) WHERE k = 1)
SELECT page_id, host, path, CASE WHEN is_host THEN rule END AS rule, CASE WHEN NOT is_host THEN rule END AS pattern, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (row)
"""
