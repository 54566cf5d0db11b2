"""Wrapper induction against plain recursions and pages made by hand."""

import random
from collections import Counter

import pytest

from strandline.llm import dom, html_extract


class Plain:
    def __init__(self, sign, kids=()):
        self.sign, self.kids = sign, list(kids)


def random_tree(rng, depth):
    return Plain(rng.choice("ab") if depth < 4 else "r", [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else [])


def largest(a, b):
    """Simple tree matching by its definition: every order-keeping choice of children is tried."""
    if a.sign != b.sign:
        return 0

    def rest(i, j):
        if i == len(a.kids) or j == len(b.kids):
            return 0
        return max(rest(i + 1, j), rest(i, j + 1), largest(a.kids[i], b.kids[j]) and largest(a.kids[i], b.kids[j]) + rest(i + 1, j + 1))

    return 1 + rest(0, 0)


def parents(tree):
    out, todo = {}, [tree]
    while todo:
        x = todo.pop()
        for k, y in enumerate(x.kids):
            out[id(y)] = (id(x), k)
            todo.append(y)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_matching_equals_the_definition(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng, 4), random_tree(rng, 4)
    size, pairs = dom.matching(a, b)
    assert size == len(pairs) == largest(a, b)
    up, down = parents(a), parents(b)
    partner = {id(x): id(y) for x, y in pairs}
    assert len(partner) == len({id(y) for _, y in pairs}) == size and all(x.sign == y.sign for x, y in pairs)
    for x, y in pairs[1:]:
        assert partner[up[id(x)][0]] == down[id(y)][0]  # ancestry
    for x, y in pairs[1:]:
        for p, q in pairs[1:]:
            if up[id(x)][0] == up[id(p)][0]:  # order
                assert (up[id(x)][1] < up[id(p)][1]) == (down[id(y)][1] < down[id(q)][1])


def test_long_lists_are_aligned_in_one_pass(monkeypatch):
    monkeypatch.setattr(dom, "CELLS", 10)
    a, b = (Plain("r", [Plain(s) for s in text]) for text in ("abcabcabc", "xbcyabzc"))
    size, pairs = dom.matching(a, b)
    assert size == len(pairs) and "".join(x.sign for x, _ in pairs[1:]) == "bcabc"


def test_folding_holds_every_layout():
    w = dom.Node("")
    pages = ["<div><h1>x</h1><p>y</p></div>", "<div><h1>x</h1><ul><li>z</li></ul><p>y</p></div>", "<table><tr><td>v</td></tr></table><div><p>y</p></div>"]
    for p in pages:
        for node, run in dom.fold(w, dom.tree(dom.parse(p))):
            assert node.sign == run.sign
    assert [k.sign for k in w.kids] == ["table", "div"] and [k.sign for k in w.kids[1].kids] == ["h1", "ul", "p"]
    before = str([k.sign for k in w.kids[1].kids])
    dom.fold(w, dom.tree(dom.parse(pages[1])))
    assert str([k.sign for k in w.kids[1].kids]) == before


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html_extract.extract(pages).collect()
    assert len(out) == len(rows)
    return {r["page_id"]: r["text"] for r in out}


NEUTRAL = """<body><div class="b1">We like visitors</div><div class="b2">Words of page {0}</div><section><div>Read on below</div><div>More of {0}</div></section>
<article><h1>Title {0}</h1><p>Body {0}</p><div class="b3">Write to the house</div></article>{1}</body>"""


def test_constant_blocks_go_and_varying_ones_stay_whatever_their_names(spark):
    rows = [(k, f"http://n.example/{k}", NEUTRAL.format(k, '<div class="b4">Closed in winter</div>' if k in (3, 6) else "")) for k in range(9)]
    got = texts(spark, rows)
    for k in range(9):
        assert got[k] == f"Words of page {k}\nMore of {k}\nTitle {k}\nBody {k}"
    alone = texts(spark, rows[3:4])  # one page tells nothing
    assert alone[3] == "We like visitors\nWords of page 3\nRead on below\nMore of 3\nTitle 3\nBody 3\nWrite to the house\nClosed in winter"


def test_two_layouts_of_one_host(spark):
    a = "<div class=x><p>Notice for all</p></div><div class=y><p>Story {0}</p></div>"
    b = "<table class=x><tr><td>Other notice</td></tr></table><div class=y><ul><li>List {0}</li></ul></div>"
    rows = [(k, f"http://two.example/{k}", (a if k % 3 else b).format(k)) for k in range(12)]
    got = texts(spark, rows)
    assert got == {k: f"Story {k}" if k % 3 else f"List {k}" for k in range(12)}


@pytest.mark.parametrize(
    "page",
    [
        '<body class="no-sidebar"><article><p>Plain words</p></article></body>',
        '<body><article class="post ad-free"><p>Plain words</p></article></body>',
        '<body><article><p data-id="ad" title="class=ad id=menu">Plain words</p></article></body>',
        '<body><div id="comment-policy"><p>Plain words</p></div></body>',
        '<body class="widget" id=menu><main class="promo"><p>Plain words</p></main></body>',
        '<body><div class="ad">Buy</div><div id="ad-box-2">Buy</div><div role=navigation>Go</div><div class="x comments">Nice</div><p>Plain words</p></body>',
    ],
)
def test_names_are_read_exactly(spark, page):
    assert texts(spark, [(1, "http://x.example/", page)]) == {1: "Plain words"}


def test_deep_and_wide_and_broken_pages(spark):
    deep = "<div>" * 5000 + "Deep words" + "</div>" * 5000
    wide = "".join(f"<p>one {k}</p><ul><li>two {k}</li></ul>" for k in range(1500))
    rows = [(1, "http://d.example/1", deep), (2, "http://d.example/2", deep.replace("Deep", "Other")), (3, "http://d.example/3", wide), (4, "http://d.example/4", wide.replace("one", "three").replace("two", "four"))]
    rows += [(5, "http://d.example/5", "</div>" * 3000 + "<b>bold <i"), (6, "http://d.example/6", "x " * 300_000), (None, "http://d.example/7", None)]
    got = texts(spark, rows)
    assert got[1] == "Deep words" and got[2] == "Other words" and got[5] == "bold" and got[None] == "" and got[6] == ("x " * 300_000).strip()
    assert got[3] == "\n".join(f"one {k}\ntwo {k}" for k in range(1500)) and got[4].startswith("three 0\nfour 0\nthree 1\n")


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(k % 4, f"http://r.example/{k % 4}", f"<div>Always here</div><p>Text {k % 4}</p>") for k in range(40)] + [(9, "http://same.example/", "<p>Only this</p>")] * 6
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("host", "grp", "n", "size", "parts", "at", "node", "text"):
        pages = pages.selectExpr("*", f"'x' AS {name}")
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract(pages).collect())
    assert got == {(k, f"Text {k}"): 10 for k in range(4)} | {(9, "Only this"): 6}
    assert html_extract.extract(pages.limit(0)).count() == 0 and html_extract.wrappers(pages.limit(0)).count() == 0


def test_large_hosts_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "GROUP_PAGES", 20)
    rows = [(k, f"http://big.example/{k}", f"<div>Always here</div><p>Text {k}</p>") for k in range(300)] + [(1000, "http://small.example/", "<p>alone</p>")]
    assert texts(spark, rows) == {k: f"Text {k}" for k in range(300)} | {1000: "alone"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = html_extract.wrappers(pages).collect()
    groups = {(r["host"], r["group"]) for r in nodes}
    assert len(groups) == 16
    assert sum(r["found"] for r in nodes if r["sign"] == "div") == 300 and {r["constant"] for r in nodes if r["sign"] == "div"} == {1}


def test_headings_and_paragraphs_that_all_pages_of_a_host_have_stay_in_articles(spark):
    page = "<nav>Menu</nav><article><h2>Summary</h2><p>Unique {0}</p><p>Serve it warm.</p><h2>Conclusion</h2><p>End {0}</p></article>"
    got = texts(spark, [(k, f"http://h.example/{k}", page.format(k)) for k in range(12)])
    assert got == {k: f"Summary\nUnique {k}\nServe it warm.\nConclusion\nEnd {k}" for k in range(12)}


def test_pages_without_an_article_keep_shared_intros_and_headings(spark):
    two = texts(spark, [(k, f"http://i.example/{k}", f"<p>Shared intro</p><p>Own {k}</p>") for k in range(2)])
    assert two == {k: f"Shared intro\nOwn {k}" for k in range(2)}
    many = texts(spark, [(k, f"http://j.example/{k}", f"<div>Always here</div><h2>Heading</h2><p>Own {k}</p><h3>Elsewhere</h3><ul><li><a href=x>One</a></li></ul>") for k in range(9)])
    assert many == {k: f"Heading\nOwn {k}" for k in range(9)}


@pytest.mark.parametrize(
    "part",
    [
        '<div class="user-comments"><p>Nice</p></div>', '<section class="post-comments-list"><p>Nice</p></section>', '<div id="all_comments"><p>Nice</p></div>',
        '<section id="discussion"><ol><li class="reply"><span class="x">Ann</span><p>Nice</p></li></ol></section>', '<div class="thread"><div><img class="avatar"><div class="comment-body">Nice</div></div></div>',
    ],
)
def test_what_readers_wrote_goes(spark, part):
    assert texts(spark, [(1, "http://c.example/", f"<article><p>Plain words</p>{part}</article>")]) == {1: "Plain words"}


def test_a_discussion_of_the_article_stays(spark):
    page = '<article><p>Plain words</p><section id="discussion"><h2>Discussion</h2><p>We found more</p></section><div class="comment-policy">Be kind</div></article>'
    assert texts(spark, [(1, "http://c.example/", page)]) == {1: "Plain words\nDiscussion\nWe found more\nBe kind"}
