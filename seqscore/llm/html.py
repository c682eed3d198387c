"""Main text of web pages by tree scoring.

A page is read into a tree. Boilerplate elements (by tag, role or class) and lists that are
mostly links are left out. Every paragraph then passes points to its ancestors: one, one for
each comma, and up to three for its length; the parent gets all, the grandparent half, those
above ever less. An element's points are discounted by the share of its text that stands in
links. The element with most points is the container of the main text (the whole article
element if it lies in one); its siblings are kept where they score well themselves, are
headings, or are running text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqscore.llm.common import slices

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: Levels that a paragraph's points climb: the share beyond is under a hundredth, and a page of
#: deeply nested elements stays linear.
REACH = 32
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = set("p pre blockquote tr dd div section article main body figcaption td".split())
# what a start tag closes, if it is open in the same list or table
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED_TAGS = set("script style noscript template iframe object embed svg canvas nav footer aside form button select textarea input label "
                   "fieldset dialog menu audio video head title".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# words in class and id that mark boilerplate, and those that mark main text
DROPPED_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                    "notices popup modal overlay sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead share "
                    "sharing social related recommended recommendations newsletter subscribe subscription signup login comment comments commentlist "
                    "disqus respond replies pagination pager widget widgets toolbar skip banner hidden".split())
MAIN_WORDS = set("article articles post entry content main story body text page blog".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "chars", "linked", "dropped", "in_link")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.points, self.chars, self.linked, self.dropped = 0.0, 0, 0, False
        self.in_link = tag == "a" or parent is not None and parent.in_link


class Tree(HTMLParser):
    """All nodes in page order; wrong nesting is mended as browsers do in the plain cases."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.now, self.nodes, self.open = self.root, [self.root], Counter()
        self.feed(html)
        self.close()

    def _up_to(self, node: Node) -> None:
        """Close everything down to and with ``node``."""
        while True:
            last = self.now
            self.open[last.tag] -= 1
            self.now = last.parent
            if last is node:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.nodes[:8]):
            return
        if tag in BLOCKS and self.open["p"]:
            node = self.now
            while node.tag != "p":
                node = node.parent
            self._up_to(node)
        if tag in CLOSES:
            closed, limits = CLOSES[tag]
            node, found = self.now, None
            while node is not self.root and node.tag not in limits and (found is None or node.tag in closed):
                if node.tag in closed:
                    found = node
                node = node.parent
            if found is not None:
                self._up_to(found)
        node = Node(tag, {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}, self.now)
        self.now.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open[tag] += 1
            self.now = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open[tag]:
            return
        node = self.now
        while node.tag != tag:
            node = node.parent
        self._up_to(node)

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def words_of(node: Node) -> set[str]:
    return {w.lower() for name in (node.attrs.get("class", ""), node.attrs.get("id", "")) for w in WORD.findall(name)}


def _boilerplate(node: Node, holds: set[int]) -> bool:
    """holds: elements that have a main, article or h1 below them; their class doesn't drop them."""
    if node.tag in DROPPED_TAGS or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" \
            or "display:none" in node.attrs.get("style", "").replace(" ", "").lower():
        return True
    words = words_of(node) if node.attrs else set()
    if node.tag == "header" or "header" in words and not words & MAIN_WORDS:
        above = node.parent
        while above is not None and above.tag not in ("article", "main"):
            above = above.parent
        if above is None:
            return True
    if node.attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    return bool(words & DROPPED_WORDS) and node.tag not in ("html", "body", "main") and id(node) not in holds


def _blocks(top: list[Node]) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) in page order below the nodes of ``top``."""
    out: list[tuple[Node, list[str], list[str]]] = []
    stack: list[tuple] = [(t, None, False) for t in reversed(top)]
    breaks = True
    while stack:
        item, block, in_link = stack.pop()
        if item is None:
            breaks = True
        elif isinstance(item, str):
            if breaks or out[-1][0] is not block:
                if not item.strip():
                    continue
                out.append((block, [], []))
                breaks = False
            out[-1][1].append(item)
            if in_link:
                out[-1][2].append(item)
        elif not item.dropped:
            own = item.tag in BLOCKS or block is None
            if own:
                stack.append((None, None, False))
                breaks = True
            inner = item if own else block
            if item.tag in ("br", "td", "th"):
                stack.append((" ", inner, False)) if not breaks else None
            stack.extend((c, inner, item.in_link) for c in reversed(item.children))
            if item.tag in ("td", "th") and not breaks:
                stack.append((" ", inner, False))
    found = [(block, " ".join("".join(parts).split()), len(" ".join("".join(links).split()))) for block, parts, links in out]
    return [b for b in found if b[1]]


def main_text(html: str) -> str:
    """The main text's blocks in page order, one a line; empty if there is none."""
    tree = Tree(html)
    holds: set[int] = set()
    for node in tree.nodes:
        if node.tag in ("main", "article", "h1"):
            while node is not None and id(node) not in holds:
                holds.add(id(node))
                node = node.parent
    holds -= {id(n) for n in tree.nodes if n.tag == "article" and words_of(n) & {"comment", "comments"}}
    for node in tree.nodes:
        node.dropped = node.parent is not None and (node.parent.dropped or _boilerplate(node, holds))
    # lists and boxes that are mostly links
    for block, text, linked in _blocks([tree.root]):
        block.chars += len(text)
        block.linked += linked
    for node in reversed(tree.nodes):  # a node comes after the one that holds it
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    for node in tree.nodes:
        if node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.chars and node.linked > 0.66 * node.chars \
                and id(node) not in holds and sum(1 for c in _links(node, 3)) >= 3:
            node.dropped = True
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
    blocks = _blocks([tree.root])
    if not blocks:
        return ""
    for block, text, linked in blocks:
        if block.tag not in PARAGRAPHS:
            continue
        points = (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)) * (1 - linked / len(text))
        node, level = block.parent if block.tag in ("p", "pre", "blockquote", "tr", "dd", "td", "figcaption") else block, 0
        while node is not None and level < REACH:
            node.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            node, level = node.parent, level + 1
    best, most = None, 0.0
    for node in tree.nodes:
        if node.dropped or node.tag in ("html", "p", "span", "b", "i", "em", "strong", "a"):
            continue
        words = words_of(node) if node.attrs else set()
        points = node.points + (25 if node.tag == "article" else 15 if node.tag == "main" else 0) * (node.chars > 0) + 10 * bool(words & MAIN_WORDS) * (node.points > 0)
        node.points = points * (1 - (node.linked / node.chars if node.chars else 0))
        if node.points > most:
            best, most = node, node.points
    if best is None:
        best = next((n for n in tree.nodes if n.tag in ("article", "main", "body") and not n.dropped), tree.root)
    node = best
    while node is not None:
        if node.tag == "article":
            best = node
        node = node.parent
    if best.tag == "article" or best.parent is None:
        kept = [best]
    else:
        kept = [c for c in best.parent.children if isinstance(c, Node) and not c.dropped and (c is best or _belongs(c, most))]
    return "\n".join(text for _, text, _ in _blocks(kept))


def _links(node: Node, enough: int) -> Iterator[Node]:
    stack, found = [node], 0
    while stack and found < enough:
        n = stack.pop()
        if n.tag == "a":
            found += 1
            yield n
        stack.extend(c for c in n.children if isinstance(c, Node))


def _belongs(node: Node, most: float) -> bool:
    """Whether a sibling of the best container is part of the main text."""
    if node.tag in HEADINGS:
        return node.linked == 0
    if node.points >= max(10.0, 0.2 * most):
        return True
    return node.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and node.linked < 0.25 * max(node.chars, 1)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``; a null page counts as empty and
    gives the empty text. Rows are independent, nothing is shuffled, and rows that repeat give
    rows that repeat. Other columns are not read."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text((h.as_py() or b"").decode("utf-8", "replace")) for h in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
