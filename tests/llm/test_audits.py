"""Token alignment, URL rules and the source audit against plain Python and their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.llm import divergence, token_align, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("term", "split", "n", "p", "block", "kind", "token", "row", "tokens", "rule", "verdict", "host", "item", "rank", "value")


def clashing(df):
    for name in CLASHES:
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [
    (1, None, "en", "a"), (2, "", None, None), (3, "  \n\t ", "en", "b"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "the of and " * 30, "en", "b"),
    (6, "the cat sat on the mat\nand the dog's 12 days, isn't it? " * 3000, "en", "c"), (7, "Éa ünï 日本語 \x00 x\x1fy  z\n\nw " * 5, "de", "c"),
    (8, "a▁b c", "de", "c"), (9, " lead and trail \n", "de", "a"), (10, "<|endoftext|> <s> <0x41> </s> ﬁ é 👍🏽", "de", "b"), (11, "\nfoo bar 　baz  q", "de", None),
    (12, "x" * 3000 + " " + "ab" * 2000, "en", "a"), (13, "tab\tin\r\nlines and   three  blanks", "en", "b"),
]


def some_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "tokenizer", "Alignment", "überall", "naïve", "12,5", "(see)", "it's", "re-use", "日本", "x1", "end."]
    rows = [(k, rng.choice([" ", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), f"s{rng.randint(0, 4)}") for k in range(n)]
    return rows + rows[:5]


# -- alignment


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = token_align._bytes_of_letters()
    assert decoders.ByteLevel().decode(list(letters)[:90]) == bytes(list(letters.values())[:90]).decode()
    word = lambda x: b"" if x is None else bytes(letters[c] for c in x)
    piece = lambda x: bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode()
    docs, total = [], Counter()
    for key, text, *_ in rows:
        got = ([], [])
        if text:
            x = [(i, word(a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(i, piece(b.id_to_piece(i))) for i in b.encode(text)]
            whole = (" " + text).encode()
            if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y):
                got = (x, y)
        spans = []
        for side in got:
            at, out = 0, []
            for i, t in side:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k and spans[1][k - 1][2] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] < e:
                if spans[1][k][2] > s:
                    links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups = [([i for i, s, e in spans[0] if lo < e <= hi], [i for i, s, e in spans[1] if lo < e <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)] if len(ends) < 2000 else None
        total.update(links)
        docs.append((key, spans, links, ends, groups))
    top = Counter()
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    out = []
    for key, spans, links, ends, groups in docs:
        sha = "" if not ends else None if groups is None else hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((key, len(spans[0]), len(spans[1]), len(ends), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), sha))
    return out, total


@pytest.mark.parametrize("block", [16_000_000, 2_000])
@pytest.mark.parametrize("rows", [ODD, some_rows(1), []], ids=["odd", "random", "empty"])
def test_alignment_equals_whole_texts(spark, rows, block):
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    parts = token_align.block_rows(docs, block_chars=block)
    want, total = plain_alignment(rows)
    assert {(r["a"], r["b"]): r["n"] for r in token_align.pair_counts(parts).collect()} == dict(total)
    got = token_align.aligned(parts)
    assert got.columns == token_align.RESULT
    key = lambda r: tuple(str(x) for x in r[:7])
    got = sorted((tuple(r) for r in got.collect()), key=key)
    want.sort(key=key)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or w[7] == g[7] for g, w in zip(got, want, strict=True))
    if rows is ODD:
        assert sum(w[1] == 0 for w in want) == 3 and any(w[1] > 3000 for w in want)


def test_both_encoders_of_the_first_tokenizer_agree():
    pair = token_align.Pair.shared(None, None)
    assert pair.fast is not None
    rng = random.Random(3)
    lines = [" " + " ".join("".join(rng.choice("abcdeßéñ日本.,'’ 12-_$́") for _ in range(rng.randint(1, 9))) for _ in range(50)) for _ in range(200)]
    assert all((x == y).all() for x, y in zip(pair._a_of(lines), pair._a_of(lines, True), strict=True))


# -- URL rules


def plain_verdict(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    sep = "[^0-9A-Za-z\x80-\U0010ffff]"
    best = None
    for rule, verdict in rules:
        if rule.startswith("~"):
            regex = "".join(".*" if c == "*" else f"(?:{sep}|^|$)" if c == "^" else re.escape(c) for c in rule[1:].strip("*"))
            fits = re.search(regex, host + path, re.S)
        else:
            h, p = rule.split("/", 1) if "/" in rule else (rule, None)
            fits = (host == h or host.endswith("." + h)) and (p is None or path.startswith("/" + p))
        if fits:
            best = min(x for x in (best, (rule.startswith("~"), -len(rule), rule, verdict)) if x)
    return host, path, best[2] if best and not best[0] else None, best[2] if best and best[0] else None, best[3] if best else "allow"


URLS = [
    None, "", "no scheme", "://", "http://", "http://COM", "http://com/", "HTTP://A.Example.COM/en/x?y=http://b.net/es/", "https://www.example.com/en/1", "https://example.com/en", "https://example.com/en/",
    "http://x.net/es/1#/fr/", "http://x.net/es", "http://x.org/casino/", "http://mycasino.org/", "http://x.org/a.exe.txt", "http://adult.org/education/", "http://adult-education.org", "http://x.org/écasino/",
    "http://x.org:80/spam-farm", "http://u@x.com/", "http://x.com:80/en/", "http://notexample.com/en/", "http://x.org/" + "long/" * 4000 + "poker/", "ftp://x.org/WP-login.php?x", "http://x.org/a\nb/casino\n", "http://É.net/fr/",
]
MORE = [("~a*b^c", "block"), ("~*", "block"), ("~^x^org*poker^", "block"), ("org", "allow"), ("x.org/a.", "block"), ("~(a)+[b]$|{c}", "block"), ("~^écasino^", "allow"), ("net/", "allow"), ("org", "block")]


@pytest.mark.parametrize("rules", [url_filter.HOST_RULES + url_filter.PATTERNS, MORE, []], ids=["own", "more", "none"])
@pytest.mark.parametrize("most", [url_filter.BROADCAST_RULES, 0])
def test_url_rules_equal_plain_matching(spark, rules, most):
    rng = random.Random(5)
    made = [f"http://{'.'.join(rng.choices(['x', 'www', 'example', 'bets', 'Ads'], k=2))}.{rng.choice(['com', 'net', 'org'])}/{'/'.join(rng.choices(['en', 'es', 'fr', 'casino', 'a(a)+[b]$|{c}', 'track', 'b-c', 'aab'], k=3))}" for _ in range(200)]
    rows = [(k, u, "h") for k, u in enumerate(URLS + made)] + [(0, None, "h"), (None, "http://x.com/", "h")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).repartition(3)
    out = url_filter.judged(pages, url_filter.rules_table(spark, rules), most)
    single = {}
    for r, v in rules:
        single[r] = min(v, single.get(r, v))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["pattern"], r["verdict"]) for r in out.collect())
    assert got == Counter((k, *plain_verdict(u, list(single.items()))) for k, u, _ in rows)
    assert url_filter.judged(pages.limit(0), url_filter.rules_table(spark, rules), most).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    rows = spark.createDataFrame([(["x", "com"],), (["com"],), (["com", "en", "example"],), (["en"],)], "tokens array<string>")
    rules = url_filter.compiled(url_filter.rules_table(spark, [("example.com/en/", "block"), ("com/", "allow"), ("~*x*", "block"), ("~^en^com^zz", "block"), ("example.com/en", "block")]))
    got = {r["rule"]: r["token"] for r in url_filter.indexed(rules, rows).collect()}
    assert got == {"example.com/en/": "example", "com/": "com", "~*x*": "", "~^en^com^zz": "en", "example.com/en": "example"}


# -- audit


def plain_audit(rows, least):
    """Every sum over all kept terms, by definition."""
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        v = len(kept)
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(t for t in terms if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * v)  # noqa: E731, B023
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(count.values(), Counter())
        for source, c in count.items():
            pairs = [(sum(gap(share(c, t), share(d, t)) for t in kept), s) for s, d in count.items() if s != source]
            terms = [(gap(share(c, t), share(whole, t)), t) for t in c if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(found[: 10 if part == "term" else None], 1)]
    return out


@pytest.mark.parametrize(("rows", "least"), [(ODD, 1), (ODD, 2), (some_rows(2, 300), 3), (some_rows(4, 100), 10), (some_rows(5, 20), 50), ([], 1)], ids=range(6))
def test_audit_equals_definition(spark, tmp_path, rows, least):
    clashing(spark.createDataFrame(rows, SCHEMA)).repartition(4).write.parquet(str(tmp_path / "d"))
    got = divergence.audit(spark.read.parquet(str(tmp_path / "d")), least).collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(rows, least))
    shuffled = divergence.audit(clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3), least).collect()
    assert sorted(map(tuple, shuffled)) == sorted(map(tuple, got))


def test_a_task_hands_on_what_it_holds(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    monkeypatch.setattr(divergence, "CHUNK", 50)
    import pyarrow as pa

    rows = some_rows(6, 50)
    text = pa.table({"split": pa.array([3] * len(rows), pa.int32()), "lang": ["en"] * len(rows), "text": pa.array([r[1].encode() for r in rows], pa.binary())})
    got = Counter()
    for b in divergence._frequencies(iter(text.to_batches(max_chunksize=7))):
        for x in b.to_pylist():
            got[x["term"]] += x["n"]
    assert got == Counter(t for r in rows for t in set(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in r[1]))))


@pytest.mark.parametrize("module", [url_filter, divergence])
def test_query_equals_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    query = next(getattr(module, x) for x in dir(module) if x.startswith("op1"))
    got, want = query(spark, SF).toPandas(), con.sql(module.ORACLE_SQL).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got) > 0
    normal = lambda df: df[cols].astype(object).where(df[cols].notna(), None).astype(str).sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(normal(got), normal(want))


def test_alignment_query_has_a_row_for_every_document(spark):
    got = token_align.op11_token_alignment(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and (got["n_links"] >= got["n_a"].clip(lower=got["n_b"])).all()
