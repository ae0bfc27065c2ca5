"""Main-text extraction from web pages by tree scoring.

A page becomes a tree; elements that are never part of an article (menus,
forms, scripts, adverts, ...) are left out by tag, role or class word; a class
word that stands on a wrapper of the article doesn't count.  Every paragraph
gives points for its length and its commas to its ancestors, less the
farther they are; a container's points are discounted by its link density.  The
article that the best container stands in is written whole.  Without an article or
main element, all of the page's blocks are written in page order, but for menus
outside of the ancestor that holds nearly all text, and before or after its paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# element names (fixed values of the HTML standard)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
                  "table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: A start tag of the key ends an open element of the values, unless one of the last column stands between.
IMPLIED_END = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
               "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"caption", "colgroup"}, {"table"}),
               "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Ends of these close everything inside; a paragraph outside of them is not closed from within.
SCOPE = frozenset("table td th caption button object template body html".split())

LEFT_OUT = frozenset("head script style noscript template iframe object embed svg canvas math video audio map nav aside footer form "
                     "button select textarea input label datalist fieldset dialog menu title search".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that mark what is no part of an article.
LEFT_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted "
                           "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar "
                           "cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox paywall "
                           "comment comments commentlist disqus discussion replies respond reply share sharing social follow "
                           "related recommended recommendations newsletter subscribe subscription signup login search pagination pager "
                           "widget tags tagcloud copyright legal disclaimer skip hidden".split())
KEEP_WORDS = frozenset("article content main body post entry story text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: has-sidebar, no-comments, layout-with-ads: the words behind tell what a page has or lacks, not what the element is.
COMPOUND = re.compile(r"(?:(?<=^)|(?<=[\s_-]))(?:has|with|no|without)[_-]+\S*")


class Node:
    __slots__ = ("tag", "parent", "kids", "out", "block", "chars", "linked", "links", "own", "commas", "points", "has_blocks",
                 "named", "plain", "titles", "articles")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.block = tag in BLOCK
        self.out, self.has_blocks = False, False
        self.chars = self.linked = self.links = self.own = self.commas = 0
        self.points = 0.0
        self.named, self.plain, self.titles, self.articles = False, 0, 0, 0


class PageTree(HTMLParser):
    """Element tree with the end tags that pages leave out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("html", None)
        self.nodes = [self.root]
        self.open: dict[str, int] = {}

    def pop(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.parent

    def end_open(self, tags: set[str], stop: frozenset[str] | set[str]) -> None:
        """Close up to the outermost element of ``tags`` that is open inside the nearest ``stop``."""
        if not any(self.open.get(t) for t in tags):
            return
        at, last = self.top, None
        while at.parent and at.tag not in stop:
            if at.tag in tags:
                last = at
            at = at.parent
        while last is not None and self.top is not last.parent:
            self.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.open.get(tag, tag == "html"):
            return
        if tag in CLOSES_P:
            self.end_open({"p"}, SCOPE)
        if tag in IMPLIED_END:
            self.end_open(*IMPLIED_END[tag])
        if tag == "body":
            while self.top.parent:
                self.pop()
        node = Node(tag, self.top)
        node.out = left_out(node, attrs)
        node.named = not node.out and named_out(node, attrs)
        self.top.kids.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.top = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't end an HTML element

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            at = self.top
            while at.tag != tag:
                if at.tag in SCOPE and tag not in SCOPE and tag not in BLOCK:
                    return
                at = at.parent
            while self.top is not at:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        self.top.kids.append(data)


def left_out(node: Node, attrs: list[tuple[str, str | None]]) -> bool:
    tag = node.tag
    if tag in LEFT_OUT:
        return True
    if tag == "header":  # a page's header; an article's own one holds its title
        at = node.parent
        while at and at.tag not in ("article", "main"):
            at = at.parent
        if at is None:
            return True
    if not attrs or tag in ("html", "body"):
        return False
    a = dict(attrs)
    style = (a.get("style") or "").replace(" ", "").lower()
    if "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return (a.get("role") or "").lower() in LEFT_OUT_ROLES


def named_out(node: Node, attrs: list[tuple[str, str | None]]) -> bool:
    """A word of class or id says that the element is no part of an article."""
    tag = node.tag
    if not attrs or tag in ("html", "body"):
        return False
    a = dict(attrs)
    names = f"{a.get('class') or ''} {a.get('id') or ''}"
    if len(names) < 2 or tag in ("article", "main") and "comment" not in names.lower():
        return False
    words = set(WORDS.findall(COMPOUND.sub(" ", CAMEL.sub("-", names).lower())))
    return bool(words & LEFT_OUT_WORDS) and not (words & KEEP_WORDS and not words & {"comment", "comments", "ad", "ads", "sidebar", "related"})


def read_tree(html: str) -> PageTree:
    page = PageTree()
    page.feed(html)
    page.close()
    return page


def release_wrappers(nodes: list[Node]) -> None:
    """Take the class words' mark off elements that wrap the article.

    These are the ancestors of the article or main element with most text, unless more stands
    outside of all marked elements; and, within that element or the page, one that holds most
    of the text outside of links, if the title is in it, or no title and little text is outside.
    """
    if not any(n.named for n in nodes):
        return
    for n in nodes[1:]:
        n.out = n.out or n.parent.out
    in_link: dict[int, bool] = {}
    for n in nodes:
        in_link[id(n)] = n.tag == "a" or n.parent is not None and in_link[id(n.parent)]
        if not n.out:
            n.titles, n.articles = int(n.tag == "h1"), int(n.tag in ("article", "main") and not n.named)
            if not in_link[id(n)]:
                n.plain = sum(len(" ".join(k.split())) for k in n.kids if isinstance(k, str))
    hearts = [n for n in nodes if n.articles]
    for n in reversed(nodes[1:]):
        if not n.out:
            n.parent.plain += n.plain
            n.parent.titles += n.titles
            n.parent.articles += n.articles

    def outermost(scope: Node) -> tuple[list[Node], dict[int, list[Node]]]:
        """Marked elements right below ``scope``, and right below each other."""
        cover, below = {id(scope): scope}, {id(scope): []}
        for n in nodes:
            if n.parent is not None and id(n) not in cover and (over := cover.get(id(n.parent))) is not None:
                cover[id(n)] = over
                if n.named:
                    below[id(over)].append(n)
                    below[id(n)] = []
                    cover[id(n)] = n
        return below[id(scope)], below

    def covered(n: Node) -> list[Node]:
        out, at = [], n.parent
        while at is not None:
            out += [at] if at.named else []
            at = at.parent
        return out

    page = nodes[0]
    heart = max(reversed(hearts), key=lambda n: n.plain, default=None)
    if heart is not None and (over := covered(heart)):
        if page.plain - sum(n.plain for n in outermost(page)[0]) < heart.plain:
            for n in over:
                n.named = False
        else:
            inside = {id(n) for n in nodes if n.named}
            for n in nodes[1:]:
                if id(n.parent) in inside:
                    inside.add(id(n))
            heart = max((n for n in reversed(hearts) if id(n) not in inside), key=lambda n: n.plain, default=None)
    scope = heart or page
    todo, below = outermost(scope)
    loose, titles = scope.plain - sum(n.plain for n in todo), scope.titles - sum(n.titles for n in todo)
    todo = list(todo)
    while todo:
        n = todo.pop()
        if 2 * n.plain > scope.plain and (n.titles or not titles and (n.articles or 4 * loose < scope.plain)):
            n.named = False
            inner = below[id(n)]
            loose += n.plain - sum(k.plain for k in inner)
            titles += n.titles - sum(k.titles for k in inner)
            todo += inner


def measure(nodes: list[Node]) -> None:
    """Text, link text and points of every element; nodes stand in document order, so children come after parents."""
    for n in nodes[1:]:
        n.out = n.out or n.named or n.parent.out
    owner: dict[int, Node] = {}
    in_link: dict[int, bool] = {}
    for n in nodes:
        p = n.parent
        owner[id(n)] = n if n.block or p is None else owner[id(p)]
        in_link[id(n)] = n.tag == "a" or p is not None and in_link[id(p)]
        if n.block and p is not None and not n.out:
            owner[id(p)].has_blocks = True
        if n.out:
            continue
        for k in n.kids:
            if isinstance(k, str) and not k.isspace():
                size = len(" ".join(k.split()))
                n.chars += size
                n.linked += size if in_link[id(n)] else 0
                home = owner[id(n)]
                home.own += size
                home.commas += k.count(",") + k.count("、") + k.count("，")
    for n in reversed(nodes[1:]):
        if not n.out:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.links += n.links + (n.tag == "a")
    for n in nodes:
        if n.block and n.own and not n.out:
            points = 1 + n.commas + min(n.own / 100, 3) if n.tag not in HEADINGS else 0.5
            at, step = n if n.has_blocks else n.parent or n, 0
            while at is not None and step < 5:
                at.points += points / (1, 2, 6, 9, 12)[step]
                at, step = at.parent, step + 1


def density(n: Node) -> float:
    return n.linked / n.chars if n.chars else 0.0


def worth(n: Node) -> float:
    return (n.points + (5 if n.tag in ("article", "main") else 0)) * (1 - density(n))


def link_list(n: Node) -> bool:
    """A menu that no tag or class gives away: three links or more and little else."""
    return n.tag in ("ul", "ol", "div", "section", "table", "p", "dl") and n.links >= 3 and density(n) > 0.75


def extract_text(html: str | None) -> str:
    """The article's blocks, one per line; empty if there is none."""
    if not html:
        return ""
    page = read_tree(html)
    release_wrappers(page.nodes)
    measure(page.nodes)
    choice = [n for n in page.nodes if n.block and n.points and not n.out and not link_list(n)]
    if not choice:
        return ""
    best = max(choice, key=worth)
    at = best
    while at is not None:  # the rest of the article that the container stands in
        if at.tag in ("article", "main"):
            best = at
            break
        at = at.parent
    lines: list[str] = []
    if best.tag == "article" and best.parent:  # an article in several elements
        for k in best.parent.kids:
            if k is best or not isinstance(k, str) and k.tag == "article" and not k.out and worth(k) >= 0.2 * worth(best):
                write_blocks(k, lines, set())
    elif best.tag in ("article", "main"):
        write_blocks(best, lines, set())
    else:
        write_blocks(page.root, lines, menus(page.nodes, best))
    return "\n".join(lines)


#: Of the text outside of links, the share that the climb from the best container has to reach.
NEARLY_ALL = 0.95


def menus(nodes: list[Node], best: Node) -> set[int]:
    """Link lists (by ``id``) of a page without an article element: all but those between the first and the
    last paragraph of the ancestor of ``best`` that holds nearly all text."""
    core = best
    while core.parent is not None and core.chars - core.linked < NEARLY_ALL * (nodes[0].chars - nodes[0].linked):
        core = core.parent
    lists = {id(n) for n in nodes if not n.out and link_list(n)}
    inside, listed = {id(core)}, set(lists)
    where, paragraphs = {}, []
    for i, n in enumerate(nodes):
        p = id(n.parent)
        if p in inside:
            inside.add(id(n))
        if p in listed:
            listed.add(id(n))
        if id(n) in inside and not n.out:
            where[id(n)] = i
            if n.block and n.own and n.tag not in HEADINGS and id(n) not in listed:
                paragraphs.append(i)
    if not paragraphs:
        return lists
    return {k for k in lists if not paragraphs[0] < where.get(k, -1) < paragraphs[-1]}


def write_blocks(start: Node, lines: list[str], skip: set[int]) -> None:
    """Append the blocks below ``start``, without the elements in ``skip`` (by ``id``)."""
    inline: list[str] = []

    def flush() -> None:
        if words := "".join(inline).split():
            lines.append(" ".join(words))
        inline.clear()

    todo: list[Node | str | None] = [start]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            inline.append(k)
        elif k.tag == "br":
            inline.append(" ")
        elif not k.out and id(k) not in skip:
            if k.block:
                flush()
                todo.append(None)
            todo.extend(reversed(k.kids))
    flush()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    One row per input row, repeated ids included.  A null or empty page, and one
    without an article, has an empty text; null ids and urls are passed on; pages are
    read whole, whatever their length and nesting; an empty table gives an empty
    result; other columns are not read.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": [extract_text(h) for h in b["html"]]})

    kind = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return (rows.mapInPandas(run, "id string, url string, text string")
            .select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars")))
