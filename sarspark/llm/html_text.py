"""Main text of web pages by composite text density.

Every DOM node has a density: its characters outside links over its tags. A block's density sum
adds the densities of its child blocks. The block with the greatest sum is the main content;
the least density on its path from body is the threshold that blocks beside that path must
reach to be kept with it. Where that path meets an article or main, the whole element is kept.
Menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are no content and are taken out before; a form, or a block that only its name calls so,
stays if it holds the page's main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object audio video canvas map datalist".split())
NOISE = frozenset("nav footer aside button select textarea menu dialog input".split())
#: Noise, unless it holds the page's main text; pages made on a server often lie in one form.
SOFT = frozenset("form fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What may stand in a head; anything else ends one whose end tag is left out.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CONTENT = frozenset(["article", "main"])
#: What closes an open element of these kinds when it starts.
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl body html article main section div td th".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead toolbar pagination pager share sharing social related recommended "
    "comment comments disqus reply replies respond skip login search widget".split()
)
#: A class that starts so says what a page has beside its content, as in "has-sidebar".
LAYOUT = frozenset("has with no without".split())
COMMENTS = ("comment", "reply", "disqus", "respond")
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_SPACES = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<[A-Za-z/!?]")


class Node:
    __slots__ = ("tag", "noise", "name", "children", "parent", "chars", "links", "tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool, name: str = ""):
        self.tag, self.parent, self.noise, self.name = tag, parent, noise, name
        self.children: list = []
        self.chars = self.links = self.tags = 0
        self.density = self.total = 0.0


def _noisy(tag: str, attrs: list[tuple[str, str | None]], parent: Node) -> bool:
    if tag in SILENT or tag in NOISE:
        return True
    if tag == "header":
        while parent is not None:
            if parent.tag in CONTENT:
                return False
            parent = parent.parent
        return True
    for name, value in attrs:
        value = (value or "").lower()
        if tag == "label" and name == "for":  # the caption of a field; other labels are words of a sentence
            return True
        if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in NOISE_ROLES:
            return True
        if name in ("class", "id") and tag in CONTENT and value.strip().startswith(COMMENTS):
            return True
    return False


def _named_noise(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """What a class or id that calls an element noise says: ``comments``, ``noise`` or, with other words in it, ``part``; else nothing."""
    found = ""
    if tag in CONTENT or tag in HEADINGS:
        return found
    for name, value in attrs:
        if name in ("class", "id"):
            for word in (value or "").lower().split():
                parts = re.split(r"[^a-z]+", word)
                if parts[0] not in LAYOUT and NOISE_WORDS.intersection(parts):
                    if any(p.startswith(COMMENTS) or p == "replies" for p in parts):
                        return "comments"
                    found = "noise" if found == "noise" or NOISE_WORDS.issuperset(filter(None, parts)) else "part"
    return found or ("part" if tag in SOFT else "")


class Tree(HTMLParser):
    """A forgiving tree of the page; unclosed elements end where HTML ends them, a cut page where it is cut."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open: Counter = Counter()  # open elements by tag, so that nothing climbs for what is not open
        self.named: list[tuple[Node, int]] = []  # open noise by name, with the open articles around it
        self.soft = False  # whether any element is noise by name

    def feed(self, data: str) -> None:
        """The page, without a tag that its end cuts off: every ``<`` of a tag then has a ``>`` behind it."""
        cut = _TAG.search(data, data.rfind(">") + 1)
        super().feed(data[: cut.start()] if cut else data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The end of a comment; one that is never closed takes the rest of the page, so it is looked for once."""
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Other declarations, and sections like CDATA, end at the next ``>``."""
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def _leave(self, node: Node) -> None:
        """Close the open elements up to and with ``node``."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            if self.named and self.named[-1][0] is self.at:
                self.named.pop()
            self.at = self.at.parent

    def _close(self, tags: frozenset | set, scopes: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        node = self.at
        while node is not self.root and node.tag not in scopes:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def _end_head(self) -> None:
        node = self.at
        while node.tag != "head":
            node = node.parent
        self._leave(node)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open["head"] and (tag == "body" or self.at.tag == "head" and tag not in IN_HEAD):
            self._end_head()
        if tag in ("html", "body"):
            return
        if tag in P_CLOSERS:
            self._close({"p"}, SCOPES)
        if tag in SAME_CLOSERS:
            stop = SCOPES - SAME_CLOSERS[tag]
            before = None
            while before is not self.at:
                before = self.at
                self._close(SAME_CLOSERS[tag], stop)
        if tag in HEADINGS and self.at.tag in HEADINGS:
            self._leave(self.at)
        articles = self.open["article"] + self.open["main"]
        if tag == "h1":  # what holds the page's titled article is its layout, whatever its name
            while self.named and self.named[-1][1] < articles:
                self.named.pop()[0].noise = False
        noisy = _noisy(tag, attrs, self.at)
        named = "" if noisy else _named_noise(tag, attrs)
        node = Node(tag, self.at, noisy or named != "", named)
        self.soft = self.soft or named != ""
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1
            if named:
                self.named.append((node, articles))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body") and self.at.tag == tag:
            self._leave(self.at)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        node = self.at
        while node is not self.root and node.tag != tag:
            if node.tag in CONTENT and tag in INLINE:
                return
            node = node.parent
        if node is not self.root:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and not data.isspace():
            self._end_head()
        self.at.children.append(data)


def _lift(root: Node) -> None:
    """Make content of what only its name calls noise, where it holds the page's main text.

    That is a block with more than half of the text outside links, or with the only h1, if no
    article, main, h1 or h2 with text stands outside such blocks. A name of noise words alone
    needs one of these inside or the h1. Reader comments count for no text of the page, and text
    never makes them content.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and (c.name or not c.noise)]
    words: dict[Node, int] = {}
    h1s: dict[Node, int] = {}
    titled: dict[Node, bool] = {}
    for node in reversed(order):
        n, h, t = 0, 0, False
        for c in node.children:
            if isinstance(c, str):
                n += len(_SPACES.sub("", c))
            elif c in words:
                n += 0 if c.noise and c.name == "comments" else words[c]
                h += h1s[c]
                t = t or titled[c]
        own = bool(n) and (node.tag in CONTENT or node.tag in ("h1", "h2"))
        words[node], h1s[node], titled[node] = 0 if node.tag == "a" else n, h + (own and node.tag == "h1"), t or own
    main = title = False  # whether what is no noise has an article or main, or a heading of the page
    met: list[Node] = []
    stack = [root]
    while stack:
        while stack:
            node = stack.pop()
            if words[node] and (node.tag in CONTENT or node.tag in ("h1", "h2")):
                main, title = main or node.tag in CONTENT, True
            for c in node.children:
                if c in words:
                    (met if c.noise else stack).append(c)
        if main:
            return
        # at most two blocks are left here: no two hold the only h1, or more than half of the text
        met = [n for n in met if h1s[root] == 1 == h1s[n] or n.name != "comments" and 2 * words[n] > words[root]]
        for n in met:
            headed, most = h1s[root] == 1 == h1s[n], n.name != "comments" and 2 * words[n] > words[root]
            if headed and (most or not title) or most and not title and (n.name == "part" or titled[n]):
                n.noise = False
                met.remove(n)
                stack.append(n)
                break


def _weigh(root: Node) -> list[Node]:
    """Set counts, densities and sums bottom-up without recursion; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.noise]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACES.sub("", c))
            elif not c.noise:
                node.chars += c.chars
                node.links += c.links
                node.tags += c.tags + 1
        if node.tag == "a":
            node.links = node.chars
        node.density = (node.chars - node.links) / (node.tags + 1)
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.noise and c.tag not in INLINE)
    return order


def _content(root: Node) -> list[Node]:
    """The main block, with the blocks beside its path that reach the threshold, in page order.

    Where the path meets an article, or else a main, that whole element is the content. A page's
    only h1 is its title and belongs to it, in whichever block before it stands.
    """
    blocks = [n for n in _weigh(root) if n.tag not in INLINE]
    best = max(blocks, key=lambda n: (n.total, n.density))  # the first of equals
    if best.total <= 0:
        best = root
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    whole = [n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"]
    if whole:
        chosen = path = [whole[-1]]  # the outermost: articles inside are parts of it
    else:
        threshold = min(n.density for n in path)
        chosen = [best]
        for node, parent in zip(path, path[1:]):
            beside = [c for c in parent.children if c is node or isinstance(c, Node) and not c.noise and c.tag not in INLINE and c.chars and c.density >= threshold]
            at = beside.index(node)
            chosen = beside[:at] + chosen + beside[at + 1 :]
    titles = [n for n in blocks if n.tag == "h1"]
    if len(titles) == 1 and titles[0] not in path and blocks.index(titles[0]) < blocks.index(chosen[0]):
        chosen = [titles[0], *chosen]
    return chosen


def _blocks(nodes: list[Node]) -> Iterator[str]:
    """The texts of blocks in page order; white space inside a block is one space."""
    part: list[str] = []

    def flush() -> str:
        text = _SPACES.sub(" ", "".join(part)).strip()
        part.clear()
        return text

    stack: list = []
    for node in reversed(nodes):
        stack += [None, node, None]  # None ends a block
    while stack:
        item = stack.pop()
        if item is None:
            if text := flush():
                yield text
        elif isinstance(item, str):
            part.append(item)
        elif item.noise:
            continue
        elif item.tag == "br":
            part.append(" ")
        else:
            inner = list(reversed(item.children))
            stack += inner if item.tag in INLINE else [None, *inner, None]
    if text := flush():
        yield text


def main_text(html: str | None) -> str:
    """The main text of a page; blocks in page order, joined by a line feed."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.soft:
        _lift(tree.root)
    return "\n".join(_blocks(_content(tree.root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page.

    Null and empty html have an empty text, as have pages without text. Ties between blocks go
    to the first in the page. Repeated rows each get a row; other columns are ignored; an empty
    table gives an empty result; ids may be of any simple type.
    """
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    out = base.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
