"""Main text of web pages by composite text density.

A page is parsed into a DOM of block elements (inline elements join their
block, and count as tags of it), in time linear in its length. Each node has its
characters, tags, link characters and link tags; its density is characters per
tag, adjusted by the share of link text. A node's density sum is the sum of its
children's densities. The subtree with the largest sum is taken; the least density
on the path from it to the body is the threshold, by which blocks beside that path
are taken or left (headings before it are taken). Boilerplate by element (nav,
footer, script, ...) and what is hidden never takes part.

Words of class, id and role only advise: they multiply the densities of a block and
of all in it by ``ADVICE``, in the sums and against the threshold, unless it holds an
article or main, or (with no article or main elsewhere) more than half of the page's
text without links. Comments and consent boxes (``BESIDE``) of any length are advised
against wherever a ``SENTENCE`` of other text is around them. Words that may also name main text (``SOFT``) only do so where half
of the text is links, or outside articles in other elements than sections,
paragraphs and headings. Blocks in the article or main around the taken subtree
have their densities divided by ``ADVICE``.

Defined results: null or empty html gives an empty text; broken markup is read
as browsers do in the main (implied end tags, unclosed elements end with their
parent); repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRS = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
_HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What a mark by class, id, role or form does to a block's density, and (its inverse) the article or main around the densest subtree.
ADVICE = 0.02
#: After so many tags whose quotes never close, quotes are no longer believed in a page.
UNCLOSED = 8

# The kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
SKIP = set("head nav footer aside script style noscript template button select option textarea iframe object embed svg canvas audio video menu dialog input title".split())
CLOSED_BY_BLOCK = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
_ENDS_NEAR = {t: {k for k, v in LIMITS.items() if t in v} for v in LIMITS.values() for t in v}
# Words in class, id or role that mark boilerplate.
NOT_MAIN = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip "
    "sidebar aside rail widget widgets related recommended recommendations trending popular more-stories "
    "comment comments commentlist respond replies reply disqus discussion "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup login "
    "share sharing social footer masthead site-header page-header site-footer copyright legal disclaimer "
    "search searchbox form contentinfo complementary".split()
)
# Those that may also name main text, and what a compound (share-bar, related_posts) may have besides words of NOT_MAIN.
SOFT = set("notice notices notification notifications alert legal disclaimer copyright related recommended recommendations trending popular discussion reply replies respond promo promotion banner search skip toc form".split())
FRAME = set("bar box block list link links item items wrapper wrap container inner outer section area panel left right top bottom main primary secondary site page global header post posts article articles entry story stories news button buttons btn icon icons count media consent".split())


# Those of reader comments and consent boxes, which may well be longer than the article.
BESIDE = set("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr".split())
#: Text besides links and headings that makes an article beside comments or a consent box, in code points.
SENTENCE = 80


class Node:
    __slots__ = ("beside", "chars", "density", "factor", "heads", "holds_main", "kids", "link_chars", "link_tags", "linked", "main", "mark", "near", "open", "parent", "skip", "sum", "tag", "tags", "text", "weight")

    def __init__(self, tag: str, parent: Node | None, mark: int) -> None:
        self.tag, self.parent, self.mark = tag, parent, mark  # as _marks; 3 also for boilerplate by element
        self.skip = self.holds_main = self.beside = False
        self.kids: list = []  # Nodes and strings in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.open = self.text = self.linked = self.heads = 0  # open inline elements of its name; all characters in it, those of links, those of headings
        self.density = self.sum = 0.0
        self.factor = self.weight = 1.0  # its own, and times those of the nodes around it
        self.main: Node | None = self if tag in ("article", "main") else parent and parent.main  # the innermost article or main
        # The nearest open element of each kind that ends with the next of its kind, up to a list or table.
        self.near: dict[str, Node] = parent.near if parent else {}
        if tag in _ENDS_NEAR:
            self.near = {k: n for k, n in self.near.items() if k not in _ENDS_NEAR[tag]}
        if tag in SAME_ENDS:
            self.near = self.near | {tag: self}


def _word(w: str) -> int:
    """2: a word for boilerplate, 1: one that may also name main text, 0: none. A compound counts if all its parts are such words, numbers or in FRAME."""
    if w in NOT_MAIN:
        return 1 if w in SOFT else 2
    parts = [p for p in re.split(r"[-_]", w) if p]
    own = [p for p in parts if p in NOT_MAIN]
    if len(parts) < 2 or not own or any(p not in NOT_MAIN and p not in FRAME and not p[0].isdigit() for p in parts):
        return 0
    return 1 if all(p in SOFT for p in own) else 2


@lru_cache(4096)
def _marks(attrs: str) -> int:
    """What class, id, role or style say of an element. 3: hidden, 2: boilerplate, 1: boilerplate unless it is main text, 0: nothing."""
    mark, seen = 0, set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in seen:
            continue
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return 3
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 3
        elif name in ("class", "id", "role"):
            mark = max([mark, *map(_word, value.split())])
    return mark


@lru_cache(4096)
def _beside(attrs: str) -> bool:
    """Whether a class, id or role names reader comments or a consent box."""
    words = " ".join((m[2] or "").strip("\"'").lower() for m in _ATTR.finditer(attrs) if m[1].lower() in ("class", "id", "role")).split()
    return any(_word(w) and BESIDE.intersection(re.split(r"[-_]", w)) for w in words)


class _Scanner:
    """Tags of a page, in linear time: no search for an end is ever made twice over the same text."""

    def __init__(self, page: str) -> None:
        self.page, self.unclosed = page, 0
        self.gone: set[str] = set()  # ends that do not occur any more

    def find(self, what: str, pos: int) -> int:
        if what in self.gone:
            return -1
        at = self.page.find(what, pos)
        if at < 0:
            self.gone.add(what)
        return at

    def tag(self, at: int) -> tuple[int, bool, str, str] | None:
        """(end, closes, name, attributes) of the tag at a ``<``; name is empty for comments and the like; None if it is text."""
        page = self.page
        if page.startswith("<!--", at):
            end = self.find("-->", at + 4)
            return (end + 3 if end >= 0 else len(page)), False, "", ""
        if page.startswith(("<!", "<?"), at):
            end = self.find(">", at)
            return (end + 1 if end >= 0 else len(page)), False, "", ""
        m = _OPEN.match(page, at)
        if m is None:
            return None
        if self.find(">", at) < 0:
            return None
        if self.unclosed < UNCLOSED:
            a = _ATTRS.match(page, m.end())
            if a is not None:
                return a.end(), bool(m[1]), m[2].lower(), page[m.end() : a.end() - 1]
            self.unclosed += 1
        end = page.find(">", m.end())
        if end < 0:
            return None
        return end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]

    def after_raw(self, tag: str, pos: int) -> int:
        """Where the text of a script or the like has ended, with its end tag."""
        m = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.page, pos)
        end = self.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.page)


def parse(page: str) -> Node:
    root = Node("body", None, 0)
    at, pos, link = root, 0, 0
    counts: dict[str, int] = {}  # open elements by name
    scan = _Scanner(page)

    def up(to: Node) -> None:
        nonlocal at
        while at is not to:
            counts[at.tag] -= 1
            at = at.parent

    while pos < len(page):
        start = page.find("<", pos)
        if start < 0:
            _text(at, page[pos:], link)
            break
        got = scan.tag(start)
        if got is None:
            after = page.find("<", start + 1)
            after = len(page) if after < 0 else after
            _text(at, page[pos:after], link)
            pos = after
            continue
        if start > pos:
            _text(at, page[pos:start], link)
        pos, close, tag, attrs = got
        if not tag or tag in ("html", "body"):
            continue
        if tag in RAW and not close:
            pos = scan.after_raw(tag, pos)
            continue
        if close and tag in INLINE and at.tag == tag and not at.open:  # the end of an inline element with a mark
            link = max(0, link - (tag == "a"))
            up(at.parent)
            continue
        if tag in INLINE and not (not close and tag in ("span", "a", "label", "small") and attrs and _marks(attrs) > 1):
            if at.tag == tag:
                at.open += -1 if close else 1
            if tag == "br":
                at.kids.append(" ")
            if not close:
                at.tags += 1
            if tag == "a":
                if close:
                    link = max(0, link - 1)
                else:
                    link += 1
                    at.link_tags += 1
            continue
        if close:
            if counts.get(tag):
                n = at
                while n.tag != tag:
                    n = n.parent
                up(n.parent)
                link = 0
            continue
        if tag in CLOSED_BY_BLOCK:
            n = at
            while n.tag == "p" or n.tag in _HEADINGS:
                n = n.parent
            up(n)
            link = 0
        elif tag in SAME_ENDS:
            while ends := [at.near[k] for k in SAME_ENDS[tag] if k in at.near]:
                up(ends[0].parent)  # a row ends its cells and the row before it, so there may be more
            link = 0
        if tag in VOID:
            continue
        if tag in SKIP or tag == "header" and at.main is None:
            mark = 3
        else:
            mark = _marks(attrs) if attrs else 0
            if mark < 3 and tag in ("form", "main"):
                mark = 2 if tag == "form" else 0  # a form may hold the whole page, so it counts as a class does
        node = Node(tag, at, mark)
        node.beside = 0 < mark < 3 and _beside(attrs)
        at.kids.append(node)
        if tag == "a":
            link += 1
        if not attrs.endswith("/"):
            at = node
            counts[tag] = counts.get(tag, 0) + 1
    _skip(root)
    return root


def _skip(root: Node) -> None:
    """Which nodes never take part (boilerplate by element, hidden), and which are advised against."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        n.text, n.linked = n.chars, n.link_chars
        stack += [k for k in n.kids if type(k) is Node and k.mark < 3]
    for n in reversed(order):
        if n.tag in _HEADINGS:
            n.heads = n.text - n.linked
        n.holds_main |= n.tag in ("article", "main") and n.mark < 2 and not n.beside
        if n.parent is not None:
            n.parent.text += n.text
            n.parent.linked += n.linked
            n.parent.heads += n.heads
            n.parent.holds_main |= n.holds_main
    stack = [root]
    while stack:
        n = stack.pop()
        inside = n.main is not None
        if n.mark == 3:
            n.skip = True
            continue
        if n.mark and not n.holds_main and n is not root:
            most = 2 * (n.text - n.linked) > root.text - root.linked and (n.parent.main is not None or not root.holds_main)
            around = n.parent.main or root
            own = lambda x: x.text - x.linked - x.heads
            most &= not n.beside or own(around) - own(n) < SENTENCE
            plain = inside or n.tag in ("section", "p") or n.tag in _HEADINGS
            if not most and (n.mark == 2 or n.beside or not plain or 2 * n.linked >= n.text > 0):
                n.factor = ADVICE
        stack += [k for k in n.kids if type(k) is Node]


def _text(at: Node, raw: str, link: int) -> None:
    text = _html.unescape(raw) if "&" in raw else raw
    at.kids.append(text)
    n = len(text.strip())
    at.chars += n
    if link:
        at.link_chars += n


def measure(root: Node) -> list[Node]:
    """Totals, densities and density sums of all nodes that take part, children before parents."""
    order, stack = [], [root]
    while stack:
        n = stack.pop()
        order.append(n)
        stack += [k for k in n.kids if type(k) is Node and not k.skip]
    order.reverse()
    for n in order:
        for k in n.kids:
            if type(k) is Node and not k.skip:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.link_chars
                n.link_tags += k.link_tags
    for n in reversed(order):  # parents first
        n.weight = n.factor * (n.parent.weight if n.parent is not None else 1.0)
    share = root.link_chars / max(root.chars, 1)
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, max(n.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            n.density = c / t * math.log(max(c / max(lc, 1) * (t / lt), 1.0) + 1e-9, base) if base > 1 else c / t
            n.density = max(n.density, 0.0)
        n.sum = n.weight * (sum(k.factor * k.density for k in n.kids if type(k) is Node and not k.skip) or (n.density if n.chars else 0.0))
    return order


def _is_heading(n: Node) -> bool:
    return n.tag in _HEADINGS or n.tag in ("header", "hgroup") and any(type(k) is Node and k.tag in _HEADINGS for k in n.kids)


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order; in them, what is advised against and below the threshold is skipped."""
    order = measure(root)
    best = max(order, key=lambda n: (n.sum, n.chars))
    if not best.chars:
        return []
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    on_path = {id(n) for n in path}
    threshold = min(n.density for n in path)
    around = {id(n.main) for n in path if n.main is not None}
    keep = {id(best)}
    for child, parent in zip(path, path[1:]):
        keep.add(id(parent))
        before = True
        for k in parent.kids:
            if k is child:
                before = False
            elif type(k) is Node and not k.skip and k.chars and 2 * k.link_chars <= k.chars:
                factor = 1 / ADVICE if k.factor == 1 and parent.main is not None and id(parent.main) in around else k.factor
                if factor * k.density >= threshold or before and k.factor == 1 and _is_heading(k):
                    keep.add(id(k))
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        if n is best or id(n) in keep and id(n) not in on_path:
            out.append(n)
        elif id(n) in keep:
            stack += [k for k in reversed(n.kids) if type(k) is Node]
    stack = list(out)
    while stack:
        for k in stack.pop().kids:
            if type(k) is Node and not k.skip:
                k.skip = k.factor * k.density < threshold and k.factor < 1
                stack.append(k)
    return out


def text_of(node: Node) -> str:
    """The node's text: white space within a block is one space, blocks are joined by one space."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if type(n) is str:
            parts.append(n)
        elif not n.skip:
            parts.append(" ")
            stack.append(" ")
            stack += reversed(n.kids)
    return _SPACE.sub(" ", "".join(parts)).strip()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return _SPACE.sub(" ", " ".join(text_of(n) for n in main_nodes(parse(page)))).strip()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
