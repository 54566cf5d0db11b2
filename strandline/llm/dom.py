"""A small, forgiving HTML reader: a tree of block elements with the text and links inside each."""

from __future__ import annotations

import html
import re
from array import array
from collections import Counter

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noframes".split())
DROPPED = frozenset("head script style noscript template iframe svg canvas object form button select textarea input nav footer aside menu dialog".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An open element of the first kind ends where one of the second kind begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
#: Words that mark what is not the article, where a whole class or id is made of them (and of words of place).
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice paywall popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Beside these and words of place, a word for comments names a part that readers wrote.
COMMENTS, READERS = frozenset(["comment", "comments"]), frozenset("all article entry page post posts reader readers story thread user users visitor visitors".split())
#: A part by such a name is what readers wrote if something in it bears a name of the second kind.
TALKS, SPEAKERS = frozenset("discussion discussions feedback responses talk thread".split()), frozenset("avatar comment commenter comments replies reply username".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, in which a constant text is no sign of a template.
TEXTUAL = HEADINGS | frozenset("blockquote caption dd dt figcaption li p pre td th".split())
PLACES = frozenset("area block bottom box container inner item left list outer right section slot top unit wrap wrapper".split())
MAIN = frozenset(["article", "main"])
#: Elements that hold the page or its article are never taken for clutter by a name.
NAMING = frozenset(["class", "id", "role"])
NEVER = MAIN | frozenset(["html", "body"])
#: Without effect: lists of children are aligned in full at any length. A test still sets it.
CELLS = 40_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"([^\s=>\"'/<]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


class Element:
    __slots__ = ("clutter", "inside", "parts", "sign", "speaks", "tag", "talks")

    def __init__(self, tag: str, sign: str, clutter: bool, inside: bool):
        self.tag, self.sign, self.clutter, self.inside = tag, sign, clutter, inside
        self.talks = self.speaks = False
        self.parts: list = []  # Element, or (text, inside a link)


def _named_clutter(token: str) -> bool:
    words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
    if any(w in COMMENTS for w in words) and all(w in CLUTTER or w in PLACES or w in READERS for w in words):
        return True
    return any(w in CLUTTER for w in words) and all(w in CLUTTER or w in PLACES for w in words)


def _element(tag: str, raw: str, parent: Element) -> Element:
    names = {}
    if "=" in raw:
        for k, a, b, c in _ATTR.findall(raw, len(tag) + 1):
            if k.lower() in NAMING:
                names.setdefault(k.lower(), (a or b or c).lower())
    first = names.get("class", "").split()
    main = tag in MAIN or names.get("role") == "main"
    clutter = parent.clutter or tag in DROPPED or (tag == "header" and not parent.inside)
    if names and not clutter and not main and tag not in NEVER:
        clutter = any(_named_clutter(t) for v in names.values() for t in v.split())
    out = Element(tag, f"{tag}.{first[0]}" if first else tag, clutter, parent.inside or main)
    if names and not main and tag not in NEVER:
        words = {w for v in names.values() for w in _SPLIT.split(v)}
        out.talks, out.speaks = not words.isdisjoint(TALKS), not words.isdisjoint(SPEAKERS)
    return out


def _drop_talks(talks: list[Element]) -> None:
    """Parts named as a discussion are clutter where something in them is named as what a reader wrote."""
    for top in talks:
        todo = [x for x in top.parts if type(x) is Element]
        while todo and not top.clutter:
            x = todo.pop()
            top.clutter = x.speaks
            todo.extend(y for y in x.parts if type(y) is Element)


def parse(source: str) -> Element:
    """The root of the tree. Inline elements are not nodes: their text belongs to the block around."""
    root = Element("", "", False, False)
    stack, links, pos, n, low, opened = [root], 0, 0, len(source), None, Counter()
    talks: list[Element] = []
    while pos < n:
        m = _TOKEN.match(source, pos)
        tok, pos = m.group(), m.end()
        if tok[0] != "<" or tok == "<":
            stack[-1].parts.append((html.unescape(tok), links > 0))
            continue
        t = _TAG.match(tok)
        if not t:
            continue  # a comment or declaration
        tag = t.group(1).lower()
        if tok[-1] != ">":
            continue  # cut off inside a tag
        if tok[1] == "/":
            if tag == "a":
                links = 0
            elif tag not in INLINE and opened[tag]:
                while stack[-1].tag != tag:
                    opened[stack.pop().tag] -= 1
                opened[stack.pop().tag] -= 1
                links = 0
            continue
        if tag in VOID:
            if tag == "br":
                stack[-1].parts.append((" ", links > 0))
            elif tag == "hr":
                stack[-1].parts.append(Element("hr", "hr", True, False))
            continue
        if tag in INLINE:
            links = 1 if tag == "a" else links
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            opened[stack.pop().tag] -= 1
            links = 0
        elif tag in SIBLINGS.get(stack[-1].tag, ()):
            opened[stack.pop().tag] -= 1
            links = 0
            if stack[-1].tag in SIBLINGS and tag in SIBLINGS[stack[-1].tag]:
                opened[stack.pop().tag] -= 1
        node = _element(tag, tok, stack[-1])
        if node.talks:
            talks.append(node)
        stack[-1].parts.append(node)
        if tag in RAW:
            if low is None:
                low = source.lower()
            end = low.find("</" + tag, pos)
            pos = n if end < 0 else end
        if not tok.endswith("/>"):
            stack.append(node)
            opened[tag] += 1
    _drop_talks(talks)
    return root


class Run:
    """Neighbouring elements of one kind: the repeated part of a page counts as one node."""

    __slots__ = ("elements", "kids", "sign")

    def __init__(self, sign: str):
        self.sign, self.elements, self.kids = sign, [], []


def tree(root: Element) -> Run:
    """The tree of runs: the children of a run are those of all its elements, neighbours of one kind as one."""
    top = Run("")
    top.elements.append(root)
    todo = [top]
    while todo:
        r = todo.pop()
        for e in r.elements:
            for x in e.parts:
                if type(x) is Element:
                    if not r.kids or r.kids[-1].sign != x.sign:
                        r.kids.append(Run(x.sign))
                    r.kids[-1].elements.append(x)
        todo.extend(r.kids)
    return top


def _candidates(x: list, y: list) -> list[tuple[int, list[int]]]:
    """For each child of x that may be matched, the children of y that it may be matched with."""
    where: dict[str, list[int]] = {}
    for j, q in enumerate(y):
        where.setdefault(q.sign, []).append(j)
    # children of one sign share one list, so this takes no room for each cell
    return [(i, where[p.sign]) for i, p in enumerate(x) if p.sign in where]


def _best(rows: list[tuple[int, list[int]]], weight, width: int) -> tuple[int, list[tuple[int, int]]]:
    """Of the cells of rows, the heaviest chain that rises in both; its weight and cells. A cell takes twelve bytes, so lists of any
    length are aligned in full."""
    if all(len(js) == 1 for _, js in rows) and all(p[1][0] < q[1][0] for p, q in zip(rows, rows[1:], strict=False)):
        return sum(weight(i, js[0]) for i, js in rows), [(i, js[0]) for i, js in rows]
    # best[j]: heaviest chain so far that ends before column j and its last cell, as a Fenwick tree of maxima
    best: list[tuple[int, int]] = [(0, -1)] * (width + 1)
    at_i, at_j, back = array("i"), array("i"), array("i")
    top, end = 0, -1
    for i, js in rows:
        new = []
        for j in js:
            k, found = j, (0, -1)
            while k > 0:
                found = max(found, best[k])
                k &= k - 1
            new.append((found[0] + weight(i, j), len(back)))
            at_i.append(i)
            at_j.append(j)
            back.append(found[1])
        for j, reached in zip(js, new, strict=True):
            if reached[0] > top:
                top, end = reached
            k = j + 1
            while k <= width:
                best[k] = max(best[k], reached)
                k += k & -k
    chain = []
    while end >= 0:
        chain.append((at_i[end], at_j[end]))
        end = back[end]
    return top, chain[::-1]


def matching(a, b) -> tuple[int, list[tuple]]:
    """Simple tree matching of two trees with sign and kids: the largest number of pairs of equal nodes that
    keeps order and ancestry. Nothing recurses, so trees may be of any depth."""
    if a.sign != b.sign:
        return 0, []
    size: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple]] = {}
    todo: list[tuple] = [(a, b, None)]
    while todo:
        x, y, cells = todo.pop()
        key = id(x), id(y)
        if cells is None:
            if key in size:
                continue
            if not x.kids or not y.kids:
                size[key] = 1
                continue
            cells = _candidates(x.kids, y.kids)
            todo.append((x, y, cells))
            for i, js in cells:
                if x.kids[i].kids:
                    todo.extend((x.kids[i], y.kids[j], None) for j in js if y.kids[j].kids)
        else:
            # a pair of which one has no children counts itself alone
            total, chain = _best(cells, lambda i, j: size.get((id(x.kids[i]), id(y.kids[j])), 1), len(y.kids))  # noqa: B023
            size[key] = 1 + total
            chosen[key] = [(x.kids[i], y.kids[j]) for i, j in chain]
    pairs, open_pairs = [], [(a, b)]
    while open_pairs:
        x, y = open_pairs.pop()
        pairs.append((x, y))
        open_pairs.extend(reversed(chosen.get((id(x), id(y)), ())))
    return size[id(a), id(b)], pairs


class Node:
    """Of a wrapper: what the pages have in common at one place. texts counts pages by what an element says there."""

    __slots__ = ("chars", "found", "kids", "linked", "sign", "texts")

    def __init__(self, sign: str):
        self.sign, self.kids, self.found, self.chars, self.linked = sign, [], 0, 0, 0
        self.texts: Counter = Counter()


def fold(wrapper: Node, page: Run) -> list[tuple[Node, Run]]:
    """Align page with the wrapper and add to the wrapper what it lacks; the node of every run of the page."""
    partner = {id(r): w for w, r in matching(wrapper, page)[1]}
    out, todo = [], [page]
    while todo:
        r = todo.pop()
        w = partner[id(r)]
        out.append((w, r))
        at = 0
        for k in r.kids:
            n = partner.get(id(k))
            if n is None:
                partner[id(k)] = n = Node(k.sign)
                w.kids.insert(at, n)
                at += 1
            else:
                at = w.kids.index(n, at) + 1
        todo.extend(r.kids)
    return out


def blocks(root: Element) -> list[tuple[Element, str, int]]:
    """Of every block in page order, without clutter: its element, its text, and how much of that stands in links.
    Any element that is not inline ends the block before it, clutter too."""
    out: list[tuple[Element, str, int]] = []
    todo: list[tuple[Element, int]] = [(root, 0)]
    while todo:
        e, at = todo.pop()
        text: list[str] = []
        linked = 0
        for k in range(at, len(e.parts)):
            x = e.parts[k]
            if type(x) is tuple:
                text.append(x[0])
                linked += len(x[0].strip()) if x[1] else 0
            else:
                todo.append((e, k + 1))
                if not x.clutter:
                    todo.append((x, 0))
                break
        said = " ".join("".join(text).split())
        if said:
            out.append((e, said, linked))
    return out
