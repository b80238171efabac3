"""Main text: literal pages, hostile pages, and a plain version of the algorithm on the test pages."""

import math
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from tessera.llm import html_text


def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><main><article><h1>Big &amp; <i>new</i>s</h1><p>First   para<br>with\nbreak.<p>Second <a href=x>link</a> para."
        "<script>if (1 < 2) x('</p>')</script></article></main><aside>Side</aside><section id=comments><p>Nice!</p></section><form>F<input></form><footer>(c)</footer></body></html>"
    )
    assert html_text.main_text(page) == "Big & news First para with break. Second link para."
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<p") is not None
    framed = "<div class='layout has-sidebar'><div class=sidebar>x</div><article><p>Main</p><div class='share-bar'>s</div></article></div>"
    assert html_text.main_text(framed) == "Main"
    plain = "<body><div id=menu><a>a</a><a>b</a></div><div><div><p>" + "word " * 80 + "</p><p>" + "more " * 60 + "</p></div></div><div class=ad>buy</div></body>"
    assert html_text.main_text(plain).split() == ["word"] * 80 + ["more"] * 60


def test_main_text_survives_class_names():
    main, nav = html_text.main_text, "<nav><a href=/>Home</a></nav>"
    body = "<p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p>"
    want = ["word"] * 40 + ["more"] * 40
    for name in ("post category-legal", "post has-sidebar", "legal", "sidebar"):
        assert main(f"{nav}<article class='{name}'>{body}</article><div class=sidebar>x</div>").split() == want
    for name in ("content has-sidebar", "content right-sidebar", "widget"):
        assert main(f"{nav}<div class='{name}'>{body}</div><div class=sidebar>x y</div>").split() == want
    assert main(f"<div class=widget>{body}</div><aside><article>x</article></aside>").split() == want
    assert main(f"{nav}<form id=form1><div>{body}</div><input></form>").split() == want
    inner = "<h2 id='related-work'>Related</h2><section id='discussion'><p>We see</p></section><p class='notice'>Mind this</p><div class='related-posts'><a href=x>Other</a></div><div class=share-bar>s</div>"
    assert main(f"<article>{body}{inner}</article>").split() == [*want, *"Related We see Mind this".split()]
    for attr in ("title='The hidden valley'", "data-hidden='false'", "data-class='ad'", "alt='style=display:none'"):
        assert main(f"<article {attr}>{body}</article>").split() == want
    assert main("<article><p>Seen</p><p hidden>a</p><p aria-hidden=true>b</p><p style='display: none'>c</p></article>") == "Seen"
    assert main("<article><p>One <span class=share><span>x</span> y</span> two <a class=comments href=x>3</a> end</p></article>") == "One two end"


def test_main_text_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</article>", 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    assert [tuple(x) for x in html_text.extract(pages).orderBy("page_id").collect()] == [(1, "u", "x", 1), (2, None, "", 0)]


def test_words_only_advise():
    main = html_text.main_text
    body = "<p>" + "word " * 40 + "</p><p>" + "more " * 40 + "</p>"
    want = ["word"] * 40 + ["more"] * 40
    for div in ("<div data-id='notice-1'>", "<div class='entry social-studies'>", "<div id='form-of-state'>", "<div class='post share-enabled'>"):
        assert main(f"<nav>x</nav>{div}{body}</div><footer>f</footer>").split() == want
        assert main(f"<nav>x</nav><article>{div}{body}</div></article><footer>f</footer>").split() == want
    three = "".join(f"<article><p>{w * 30}</p><p>{w * 20}</p></article>" for w in ("one ", "two ", "three "))
    assert main(f"<nav>x</nav>{three}<div class=ad>buy now</div>").split() == ["one"] * 50 + ["two"] * 50 + ["three"] * 50
    said = "<section class=comments>" + "".join(f"<div class=comment><p>{'reader ' * 40}</p></div>" for _ in range(4)) + "</section>"
    assert main(f"<article>{body}{said}</article>").split() == want
    assert main(f"<article>{body}</article>{said}").split() == want
    assert main(f"<div id=content><h1>Head line</h1><div>{body}</div></div>{said}").split() == ["Head", "line", *want]


def test_comments_beyond_half_a_page():
    page = "<article><p>" + "word " * 60 + "</p></article><section class=comments>" + "".join(f"<p>{'said ' * 50}</p>" for _ in range(9)) + "</section>"
    assert html_text.main_text(page).split() == ["word"] * 60


def test_comments_and_boxes_longer_than_the_article():
    """Few long comments, nested replies and consent boxes, beside the article and in it, with and without an article element."""
    said = lambda n: f"<p>{'said ' * n}</p>"
    threads = [
        "<section id='comments'>" + f"<div class='comment'>{said(120)}</div>" * 2 + "</section>",
        "<section id=comments>" + f"<div class=comment>{said(238)}</div>" * 2 + "</section>",
        "<div class=comment-list><ol>" + f"<li class=comment><div>{said(100)}<ol><li class=comment><div>{said(475)}</div></li></ol></div></li>" * 3 + "</ol></div>",
        f"<div class='cookie-consent'>{said(240)}</div>",
        f"<div id=gdpr><div><div>{said(300)}{said(300)}</div></div></div>",
        "<div class=replies>" + f"<article class=reply>{said(200)}</article>" * 2 + "</div>",
    ]
    for paragraphs in (1, 2, 3, 5):
        body = "".join(f"<p>{'word ' * 40}</p>" for _ in range(paragraphs))
        want = ["word"] * 40 * paragraphs
        for thread in threads:
            for page in (f"<article>{body}</article>{thread}", f"{thread}<article>{body}</article>", f"<article>{body}{thread}</article>", f"<main><h1>Head</h1><div>{body}</div>{thread}</main>", f"<div class=content>{body}</div>{thread}", f"<div>{body}{thread}</div>"):
                assert html_text.main_text(page).split() == (["Head"] if "<h1>" in page else []) + want, page[:200]
    only = f"<article><h1>Head</h1><div class=comments>{said(100)}</div></article>"
    assert html_text.main_text(only).split() == ["Head"] + ["said"] * 100  # nothing else is there: the box is the text


def test_empty_table_repeats_and_clashes(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, sum string"
    rows = [(1, "u", "<article><p>x y</article>", "a", "b", "c")] * 2 + [(None, None, "", "a", "b", "c")]
    got = sorted(map(repr, map(tuple, html_text.extract(spark.createDataFrame(rows, schema)).collect())))
    assert got == sorted(map(repr, [(1, "u", "x y", 3)] * 2 + [(None, None, "", 0)]))
    empty = html_text.extract(spark.createDataFrame([], schema))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0


def test_ties_of_equal_subtrees():
    """Equal density sums: the first in page order of the innermost ones is taken, and its equal neighbours with it."""
    assert html_text.main_text("<div><p>one two three</p></div><div><p>one two three</p></div>") == "one two three one two three"


def test_hostile_pages_take_linear_time():
    k = 40_000
    pages = ["<div></p>" * k, "<a " * k, "<a '" * k, '<a "x> ' * k, "<li><ul>" + "<div>" * k + "<li></li>" * k, "<div>" * k + "<header>x</header>" * k]
    pages += ["<script>" + "</script " * k, "<!--" * k, "<b>x" * k, "<table>" + "<tr><td>x" * k, "<" * k, "<a " + " " * k + "x", "<div " + "a " * k + ">"]
    for page in pages:
        t = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - t < 3, page[:30]


class Plain(HTMLParser):
    """Nested lists of the page's blocks: [tag, class, kids], an inline element counted in its block."""

    def __init__(self):
        super().__init__()
        self.root = ["body", "", []]
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return
        if tag in html_text.INLINE:
            self.stack[-1][2].append((tag,))
            return
        if tag == "meta":
            return
        while tag not in html_text.INLINE and self.stack[-1][0] in ("p", "h1"):
            self.stack.pop()
        node = [tag, dict(attrs).get("class", ""), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.stack[1:]):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][2].append(data)


def plain_text(page):
    """The algorithm by its definition, for pages without forms, headers, hidden parts or nested links."""
    reader = Plain()
    reader.feed(page)
    reader.close()
    gone = ("head", "nav", "footer", "aside", "script", "style")
    kids = lambda n: [k for k in n[2] if isinstance(k, list) and k[0] not in gone]
    chars = lambda n: sum(len(k.strip()) for k in n[2] if isinstance(k, str)) + sum(map(chars, kids(n)))
    tags = lambda n: sum(isinstance(k, tuple) for k in n[2]) + sum(tags(k) + 1 for k in kids(n))
    factor = lambda n: html_text.ADVICE if n[1] == "ad" else 1

    def density(n):
        c, t = chars(n), max(tags(n), 1)
        return c / t * max(math.log(max(c * t, 1) + 1e-9), 0) if c else 0

    def total(n, above):
        """What is said against a block counts for all in it."""
        return math.prod(map(factor, [n, *above])) * (sum(factor(k) * density(k) for k in kids(n)) or density(n))

    every = []
    walk = lambda n, above: every.append((n, above)) or [walk(k, [n, *above]) for k in kids(n)]
    walk(reader.root, [])
    best, above = max(every, key=lambda x: (total(*x), chars(x[0])))
    least = min(density(n) for n in [best, *above])

    def text(n, taken):
        out = ""
        for k in n[2]:
            if isinstance(k, str):
                out += k if taken else ""
            elif isinstance(k, tuple):
                out += " " if k[0] == "br" else ""
            elif k[0] in gone:
                continue
            elif taken:
                out += " " + text(k, factor(k) == 1 or factor(k) * density(k) >= least) + " "
            elif k is best or any(k is a for a in above):
                out += " " + text(k, k is best) + " "
            elif any(n is a for a in above) and chars(k):
                inside = any(a[0] == "article" for a in [n, *above[[i for i, a in enumerate(above) if a is n][0] :]])
                f = 1 / html_text.ADVICE if factor(k) == 1 and inside else factor(k)
                before = [x is k or x is best or any(x is a for a in above) for x in n[2]]
                first = next(x for x, ok in zip(n[2], before) if ok)
                if f * density(k) >= least or factor(k) == 1 and k[0] == "h1" and first is k:
                    out += " " + text(k, True) + " "
        return out

    return " ".join(text(reader.root, best is reader.root).split())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_plain_version_agrees(sf):
    pages = pq.read_table(f"/root/testdata/{sf}/pages.parquet").column("html").to_pylist()
    assert [html_text.main_text(p) for p in pages] == [plain_text(p) for p in pages]
