"""Main text of web pages by scoring their element tree.

Pages are parsed leniently (unclosed and stray tags, attributes without a closing quote, raw elements, comments without
an end). Elements that are never content (navigation, headers, footers, asides, forms, scripts ...) or have such a role
are left out. A class or id that names what is not content (``ad``, ``site-footer``, ``comment-list``) is evidence that
the element's own text can outweigh: with few links and most of the text of a page without an article it stays, unless it
names comments. Where such a word is only part of another name (``social-history``), or the id of a section or paragraph
(ids are often made from headings), only links speak against the element, and within an article only if they are half of
its text. Names of headings don't count, and those of paragraphs only if they are of comments, adverts or notices. Each
paragraph then passes points to its ancestors, one and more for its commas and its length, whole to the parent,
half to the grandparent and less above; a container's points are discounted by its link density. The best container
(or the article around it) is kept with the siblings that have a fair part of its points or read like prose, and with
sibling articles. Of a main part (or an article of articles) around it all is kept but blocks of links, paragraphs that
are nothing but links, and what is named so. No rule looks at the length of a text by itself.

Edge cases: null and empty pages have an empty text, and so have pages without any block; character references are
decoded once; white space inside a block (line breaks too) becomes one space; repeated rows give repeated rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import framed

#: A quoted value ends before white space, "/" or ">", or holds no "<"; else the quote was never closed, and the tag ends
#: at the next ">".
_TAG = re.compile(
    r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|\"[^\"<]*\"|'[^']*'(?=[\s/>])|'[^'<]*')*))>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/]"
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var img wbr br picture source".split())
NEVER = frozenset("head script style textarea title noscript iframe svg math template nav footer aside form button select option input dialog menu object embed canvas audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Words of a class or id that name what is not content.
NAMES = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promoted banner nav navbar navigation menu menubar sidebar side aside "
    "footer foot header masthead breadcrumb breadcrumbs pagination pager notice notices cookie cookies consent gdpr alert alerts "
    "modal popup overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar search form skip outbrain taboola".split()
)
#: Of these, what also speaks against a paragraph.
LOUD = COMMENTS | frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted notice notices cookie cookies consent gdpr alert alerts banner newsletter".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that such a name may hold besides.
PLAIN = frozenset(
    "site page top bottom left right primary secondary main list box wrap wrapper container block inner outer section area item items links link bar global user users reader readers unit slot "
    "panel row col column group holder region module thread post posts article articles stories more us up down buttons button icons media policy law eu text content body title text label form".split()
)
#: An opening tag ends an open element of these, up to the nearest one of the bounds.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
SCOPE = frozenset("html body article section main div table td th ul ol dl blockquote nav aside footer header form button".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())


class Node:
    __slots__ = ("tag", "names", "weak", "parent", "kids", "drop", "lang")

    def __init__(self, tag: str, parent: Node | None, names: frozenset = frozenset(), drop: bool = False, weak: bool = False):
        self.tag, self.parent, self.names, self.drop, self.weak = tag, parent, names, drop, weak
        self.kids: list[Node | str] = []
        self.lang = ""


def _named(attrs: str) -> tuple[frozenset, bool]:
    """Words of a class and id that name what is not content, and whether one only occurs in another name."""
    strong, weak = set(), False
    for name in attrs.lower().split():
        parts = _WORD.findall(name)
        own = NAMES.intersection(parts)
        if own and all(p in NAMES or p in PLAIN or p.isdigit() for p in parts):
            strong |= own
        elif own:
            weak = True
    return frozenset(strong), weak


def _names(tag: str, classes: str, own_id: str) -> tuple[frozenset, bool]:
    """What an element's class and id say against it, and whether that counts only with links."""
    if tag in HEADINGS:
        return frozenset(), False
    names, weak = _named(classes)
    by_id, weak_id = _named(own_id)
    if tag in ("p", "section"):
        weak_id, by_id = weak_id or bool(by_id - COMMENTS), by_id & COMMENTS
    if tag == "p":
        weak, names = weak or bool(names - LOUD), names & LOUD
    return names | by_id, weak or weak_id


def _opened(tag: str, attrs: str, parent: Node) -> Node:
    names, drop, weak = frozenset(), tag in NEVER, False
    if attrs and not attrs.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        names, weak = _names(tag, found.get("class", ""), found.get("id", ""))
        drop = drop or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        if found.get("role", "").lower() == "main":
            names |= {"role-main"}
    return Node(tag, parent, names, drop, weak)


class _Open:
    """The open elements while a page is parsed, with what is open of each tag, so that a tag that closes nothing costs
    nothing. ``inline`` counts inline elements opened since the last other one, in which alone their end tags reach."""

    def __init__(self, root: Node):
        self.root = self.here = root
        self.count: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]

    def enter(self, node: Node) -> None:
        self.here = node
        self.count[node.tag] += 1
        if node.tag in INLINE:
            self.inline[-1][node.tag] += 1
        else:
            self.inline.append(Counter())

    def leave(self, node: Node) -> None:
        """Close an open element and all within it."""
        while True:
            own = self.here
            self.here = own.parent
            self.count[own.tag] -= 1
            if own.tag in INLINE:
                self.inline[-1][own.tag] -= 1
            else:
                self.inline.pop()
            if own is node:
                return

    def end(self, tag: str) -> None:
        if not (self.inline[-1] if tag in INLINE else self.count)[tag]:
            return
        node = self.here
        while node.tag != tag:
            node = node.parent
        self.leave(node)

    def make_room(self, tag: str) -> None:
        """Close what the opening tag of another block or item ends."""
        if tag not in INLINE and self.count["p"]:
            node = self.here
            while node is not self.root and node.tag != "p" and node.tag not in SCOPE:
                node = node.parent
            if node.tag == "p":
                self.leave(node)
        ends, bounds = ENDS.get(tag, (frozenset(), frozenset()))
        if any(self.count[x] for x in ends):
            node, last = self.here, None
            while node is not self.root and node.tag not in bounds:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                self.leave(last)


def parse(page: str) -> Node:
    """The element tree of a page; text is kept as it is, and of html elements the first language declared."""
    root = Node("html", None)
    open_, at, n = _Open(root), 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            open_.here.kids.append(page[at:])
            break
        if m.start() > at:
            open_.here.kids.append(page[at : m.start()])
        slash, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                at = n if end < 0 else end + 3
            else:  # a doctype or another declaration
                end = page.find(">", m.end())
                at = n if end < 0 else end + 1
            continue
        tag, at = tag.lower(), m.end()
        if slash:
            open_.end(tag)
            continue
        if tag == "html":
            if not root.lang:
                root.lang = next((x[2] or x[3] or x[4] or "" for x in _ATTR.finditer(attrs) if x[1].lower() == "lang"), "")
            continue
        open_.make_room(tag)
        new = _opened(tag, attrs, open_.here)
        open_.here.kids.append(new)
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            if end is None:
                at = n
            else:
                at = page.find(">", end.start()) + 1 or n
        elif tag not in VOID:
            open_.enter(new)
    return root


def _marked(node: Node) -> bool:
    """Mark what is left out; whether the element holds an article or a main part."""
    holds = node.tag in ("article", "main") or "role-main" in node.names
    stack = [(node, iter([k for k in node.kids if isinstance(k, Node)]))]
    found = {id(node): holds}
    while stack:
        own, kids = stack[-1]
        kid = next(kids, None)
        if kid is not None:
            found[id(kid)] = kid.tag in ("article", "main") or "role-main" in kid.names
            stack.append((kid, iter([k for k in kid.kids if isinstance(k, Node)])))
            continue
        stack.pop()
        if own.parent is not None:
            inner = found[id(own)]
            if not inner and own.tag != "body" and (own.names & NAMES or own.tag == "header"):
                own.drop = own.drop or not (own.tag == "header" and _inside_article(own))
            if own.drop and inner and own.tag in ("form", "header"):
                own.drop = False  # a page wrapped in one
            found[id(own.parent)] |= inner
    return found[id(node)]


def _inside_article(node: Node) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.parent
    return False


def _walk(node: Node):
    """("in"/"out", element) and ("text", str) in page order, without what is left out."""
    if node.drop:
        return
    stack = [(node, iter(node.kids))]
    yield "in", node
    while stack:
        own, kids = stack[-1]
        kid = next(kids, None)
        if kid is None:
            yield "out", own
            stack.pop()
        elif isinstance(kid, str):
            yield "text", kid
        elif not kid.drop:
            yield "in", kid
            stack.append((kid, iter(kid.kids)))


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under an element."""
    out, now = [], []

    def end():
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    for kind, what in _walk(node):
        if kind == "text":
            now.append(what)
        elif what.tag in ("br", "img", "wbr"):
            if kind == "in" and what.tag == "br":
                now.append(" ")
        elif what.tag not in INLINE:
            end()
    end()
    return out


def _sizes(root: Node) -> tuple[dict[int, int], dict[int, int]]:
    """Characters, and characters in links, under each element."""
    text, link, path, in_link = {}, {}, [], 0
    for kind, what in _walk(root):
        if kind == "in":
            path.append((what, 0, 0))
            in_link += what.tag == "a"
        elif kind == "text":
            n = len(" ".join(what.split()))
            own, t, k = path[-1]
            path[-1] = (own, t + n, k + (n if in_link else 0))
        else:
            own, t, k = path.pop()
            in_link -= own.tag == "a"
            text[id(own)], link[id(own)] = t, k
            if path:
                up, a, b = path[-1]
                path[-1] = (up, a + t, b + k)
    return text, link


def _weighed(root: Node) -> None:
    """Let an element's text speak against its name, or for one that is only part of another name."""
    text, link = _sizes(root)
    whole, every = text.get(id(root), 0), [what for kind, what in _walk(root) if kind == "in"]
    articles = any(x.tag in ("article", "main") or "role-main" in x.names for x in every)
    for node in every:
        if not (node.weak or node.names & NAMES):
            continue
        n = text.get(id(node), 0)
        linked = link.get(id(node), 0) / max(1, n)
        if node.weak and not node.names & NAMES and linked >= (0.5 if articles and _inside_article(node) else 0.25):
            node.names |= {"side"}
        elif node.names & NAMES and not node.names & COMMENTS and not articles and 2 * n >= whole and linked < 0.25:
            node.names -= NAMES


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings kept with it, in page order."""
    _weighed(root)
    _marked(root)
    text, link = _sizes(root)
    density = lambda x: link.get(id(x), 0) / max(1, text.get(id(x), 0))
    points: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    every = [what for kind, what in _walk(root) if kind == "in"]
    for node in every:
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.parent is None or not (node.tag in PARAGRAPHS or (node.tag in ("div", "section", "article", "main") and own >= 25)):
            continue
        if text[id(node)] < 25 or any(isinstance(k, Node) and k.tag in PARAGRAPHS for k in node.kids):
            continue
        worth = 1 + _commas(node) + min(text[id(node)] // 100, 3)
        up, level = (node if node.tag not in PARAGRAPHS else node.parent), 0
        while up is not None and up.tag != "html" and level < 5:
            if id(up) not in points:
                points[id(up)] = {"article": 15.0, "main": 15.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "li": -3.0, "ul": -3.0, "ol": -3.0}.get(up.tag, 0.0)
                nodes[id(up)] = up
            points[id(up)] += worth / (1, 2, 6, 9, 12)[level]
            up, level = up.parent, level + 1
    score = {k: v * (1 - density(nodes[k])) for k, v in points.items()}
    if not score:
        return [x for x in every if x.tag in ("article", "main")][:1] or [x for x in every if x.tag == "body"][:1] or [root]
    best = max(score, key=score.get)
    top, node, near, holder = nodes[best], nodes[best], None, None
    while node is not None:
        if node.tag in ("article", "main") or "role-main" in node.names:
            near, holder = near or node, node
        node = node.parent
    if holder is not None:
        # up to the outermost article or main part, all stays but links and what is named as no content
        while near is not holder:
            for kid in near.parent.kids:
                if isinstance(kid, Node) and kid is not near and kid.tag not in HEADINGS and (kid.names & NAMES or density(kid) >= (1.0 if kid.tag in ("p", "blockquote") else 0.5)):
                    kid.drop = True
            near = near.parent
        if holder.tag != "article" or "role-main" in holder.names:
            return [holder]
        top = holder
    if top.tag == "body" or top.parent is None:
        return [top]
    least = max(10.0, 0.2 * score[best])
    kept = []
    for kid in top.parent.kids:
        if not isinstance(kid, Node) or kid.drop or kid is not top and kid.names & NAMES:
            continue
        n, d = text.get(id(kid), 0), density(kid)
        prose = kid.tag == "p" and (n > 80 and d < 0.25 or 0 < n <= 80 and d == 0 and "." in "".join(x for x in kid.kids if isinstance(x, str)))
        if kid is top or score.get(id(kid), 0) >= least or prose or kid.tag in ("h1", "h2") or kid.tag == "article" and d < 0.5:
            kept.append(kid)
    return kept


def _commas(node: Node) -> int:
    return sum(what.count(",") + what.count("،") + what.count("、") + what.count("，") for kind, what in _walk(node) if kind == "text")


def main_text_of(root: Node) -> str:
    """Blocks of a tree's main text, joined by line feeds."""
    return "\n".join(b for node in main_nodes(root) for b in blocks(node))


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line feeds."""
    return main_text_of(parse(page)) if page else ""


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (all columns of a page) and ``text``."""
    column = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            yield pa.record_batch([row, pa.array([main_text(x) for x in row.field(column).to_pylist()], pa.string())], ["row", "text"])

    frame, schema = framed(pages, "text string")
    return frame.mapInArrow(run, schema)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """A row a page: its address, main text and the text's code points. Null and empty pages have an empty text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
