"""Main text of web pages by wrapper induction.

The pages of a host are folded into its wrapper one after the other: simple tree matching aligns the tree of a page
with that of the wrapper (neighbouring elements of one kind count as one node), and what the wrapper lacks is added
to it, so that it comes to hold every layout and every optional block of the host. Each node of the wrapper counts
the pages it was found on, and for every text that an element of it had, the pages that say the same. A text that
stands at one node on nearly all pages that have the node is template and goes, on two pages already; on four, where a page has
neither ``article`` nor ``main``, as all of it may be the article. A heading is judged by what comes after it: one that all pages
have stays in front of text that stays. Inside ``article`` and ``main`` headings, paragraphs, list items and the like always stay,
however many pages say the same; what else is constant there goes on five pages, at a node that says nothing else. Nodes whose text varies are slots, and are content, unless they are menus
(made of links, outside the article), what HTML itself names as no part of the article (nav, footer, aside, forms,
scripts), or bear a class or id that is wholly made of words such as "ad" or "comments" (also "user-comments"), or are named as a
discussion and hold something that is named as a reply, a comment or who wrote it. If all that is left of a page
is template, nothing tells it from content: then its constant text stays.

Pages are dealt by host once, and nothing else is shuffled but two numbers of each host. A host of more than
GROUP_PAGES pages or GROUP_BYTES bytes is dealt by row into groups that have a wrapper each, so a task never holds
more than a group, of which it keeps wrapper and texts, and of equal pages one.

Defined results for odd input: a null html is an empty page with an empty text; pages without a readable
host form a host of their own; a host with one page has no template, only slots; repeated rows are separate
pages, but equal html counts once as evidence; broken or cut off markup is read as far as it goes; pages may be nested to
any depth; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, repeatable, stored
from .dom import HEADINGS, TEXTUAL, Node, blocks, fold, parse, tree

#: A text is template where it stands on this share of the pages that have its node, and on so many pages.
SAME_SHARE = 0.9
LEAST_PAGES, LEAST_BARE, LEAST_INSIDE = 2, 4, 5
#: A node outside the article is a menu where this share of its characters stands in links.
LINK_SHARE = 0.6
GROUP_PAGES, GROUP_BYTES = 500, 16 << 20


class Wrapper:
    """The wrapper of one group of pages."""

    def __init__(self):
        self.root = Node("")
        #: By page: node, tag, whether inside the article, and text of every block; and whether there is an article
        self.pages: dict[bytes, tuple[list[tuple[Node, str, bool, str]], bool]] = {}

    def add(self, source: str) -> bytes:
        """Fold a page into the wrapper; its key."""
        key = hashlib.blake2b(source.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if key in self.pages:
            return key
        root = parse(source)
        node = {}
        for w, r in fold(self.root, tree(root)):
            w.found += 1
            for e in r.elements:
                node[id(e)] = w
        said = []
        seen = set()
        for e, text, linked in blocks(root):
            w = node[id(e)]
            w.chars += len(text)
            w.linked += linked
            if (w, text) not in seen:
                seen.add((w, text))
                w.texts[text] += 1
            said.append((w, e.tag, e.inside, text))
        self.pages[key] = said, any(inside for _, _, inside, _ in said)
        return key

    @staticmethod
    def constant(w: Node, tag: str, inside: bool, article: bool, text: str) -> bool:
        """Whether a text is template at its node. Outside the article of a page that has one, two pages are enough; a page without
        one may be all article."""
        n = w.texts[text]
        if inside:
            return tag not in TEXTUAL and n >= LEAST_INSIDE and n >= SAME_SHARE * w.found and w.texts.total() - n <= (1 - SAME_SHARE) * w.found
        return n >= (LEAST_PAGES if article else LEAST_BARE) and n >= SAME_SHARE * w.found

    def text(self, key: bytes) -> str:
        """What is left of a page."""
        said, article = self.pages[key]
        menu = [not inside and w.linked > LINK_SHARE * w.chars for w, _, inside, _ in said]
        keep = [not m and not self.constant(w, tag, inside, article, t) for m, (w, tag, inside, t) in zip(menu, said, strict=True)]
        for k in range(len(said) - 2, -1, -1):  # a constant heading belongs to what comes after it
            if said[k][1] in HEADINGS and not menu[k] and said[k][2] == said[k + 1][2]:
                keep[k] = keep[k] or keep[k + 1]
        if not any(keep):
            keep = [not m for m in menu]
        return "\n".join(t for k, (_, _, _, t) in zip(keep, said, strict=True) if k)

    def nodes(self):
        """(number, parent's number, sign, pages found on, texts, constant texts, share in links) in page order."""
        todo, n = [(self.root, None)], 0
        while todo:
            w, up = todo.pop()
            fixed = sum(c >= LEAST_PAGES and c >= SAME_SHARE * w.found for c in w.texts.values())
            yield n, up, w.sign, w.found, len(w.texts), fixed, w.linked / w.chars if w.chars else 0.0
            todo.extend((k, n) for k in reversed(w.kids))
            n += 1


def _groups(batches):
    """Rows sorted by host and group -> (host, group, [(page_id, url, key)], wrapper)."""
    at, rows, wrapper = None, [], Wrapper()
    for batch in batches:
        for host, group, page_id, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, group) != at:
                if rows:
                    yield *at, rows, wrapper
                at, rows, wrapper = (host, group), [], Wrapper()
            rows.append((page_id, url, wrapper.add(source)))
    if rows:
        yield *at, rows, wrapper


def _extract(batches):
    for _, _, rows, wrapper in _groups(batches):
        for a in range(0, len(rows), 256):
            ids, urls, keys = zip(*rows[a : a + 256], strict=True)
            cols = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([wrapper.text(k) for k in keys], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text"])


def _nodes(batches):
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["node", "parent", "sign", "found", "texts", "constant", "linked"]
    for host, group, _, wrapper in _groups(batches):
        cols = list(zip(*wrapper.nodes(), strict=True))
        n = len(cols[0])
        yield pa.RecordBatch.from_arrays([pa.array([host] * n), pa.array([group] * n, pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["host", "group", *names])


def _grouped(pages: DataFrame) -> DataFrame:
    """host, grp, page_id, url, html, dealt and sorted by group."""
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    slim = repeatable(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host")))
    sizes = slim.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("size"))
    parts = F.greatest(F.ceil(F.col("n") / GROUP_PAGES), F.ceil(F.col("size") / GROUP_BYTES))
    # only hosts that need several groups are joined; the others keep one
    large = stored(sizes.select("host", parts.alias("parts")).where("parts > 1"), "large-hosts")
    # dealt by the row's number, not its contents: equal rows may be many
    numbered = slim.withColumn("at", F.xxhash64(F.monotonically_increasing_id()))
    dealt = numbered.join(large, "host", "left").withColumn("grp", F.pmod("at", F.coalesce("parts", F.lit(1))))
    return dealt.select("host", "grp", "page_id", "url", "html").repartition("host", "grp").sortWithinPartitions("host", "grp", "page_id", "url", "html")


def wrappers(pages: DataFrame) -> DataFrame:
    """The nodes of every host's wrapper: pages found on, texts, constant texts, share of characters in links."""
    return _grouped(pages).mapInArrow(_nodes, "host string, group long, node int, parent int, sign string, found long, texts long, constant long, linked double")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    return _grouped(pages).mapInArrow(_extract, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE_SQL = None
