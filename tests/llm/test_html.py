"""HTML extraction: simple tree matching against a plain recursion, templates, class words, and pages of any size."""

import random
import time

import numpy as np
import pytest

from quill.llm import html_extract
from quill.llm.html_extract import Matcher, read


def bare(html):
    return html_extract.main_text(read(html))


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body class='has-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
    "<div class=\"cookie-notice\">Cookies!</div><article><h1>{0} &amp; more</h1><p>First   <b>{0}</b>\n line<br>two<p>Second &lt;x&gt; {0}<p>Follow our channel for daily updates</article>"
    "<form><input name=q>Find</form><section id='comments'><p>Reader says</p></section><aside>Side</aside><footer>&copy; 2020</footer></body></html>"
)


def test_extraction(spark):
    pages = [(i, f"http://h.example/{i}", PAGE.replace("{0}", f"topic{i}")) for i in range(6)]
    pages += [(10, "http://other.example/", PAGE.replace("{0}", "solo")), (11, None, "<p>a<p>b &eacute;"), (12, "http://h.example/n", None), (13, "x", ""), (14, "http://h.example/0", pages[0][2]), (15, "http://u.example", "<div><p>open <script>never closed")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    want = lambda w: f"{w} & more\n\nFirst {w} line two\n\nSecond <x> {w}"
    assert all(got[i].text == want(f"topic{i}") for i in range(6)) and got[14].text == want("topic0")  # the constant paragraph is template
    assert got[10].text == want("solo") + "\n\nFollow our channel for daily updates"
    assert got[11].text == "a\n\nb é" and got[12].text == "" and got[13].text == "" and got[15].text == "open"
    assert all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(pages)
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "right-sidebar", "site header", "tags", "search-page"])
def test_class_words_do_not_empty_pages(spark, name):
    wrapped = f"<body><div class='{name}'><article><p>Main text {{0}}</article><div class='sidebar'>Side words</div></div><div class='comments'>Said</div></body>"
    plain = f"<body><div id='{name}'><p>The long main text of page {{0}}</div><div class='sidebar'>Side</div><div class='menu'>Go</div></body>"
    pages = [(i, f"http://h.example/{i}", wrapped.replace("{0}", f"w{i}")) for i in range(4)] + [(9, "http://o.example/", plain.replace("{0}", "nine"))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Main text w{i}" for i in range(4)}, 9: "The long main text of page nine"}
    
    assert bare("<div class=related><p>All there is</div>") == "All there is"
    assert bare("<article>The main text</article><div class=related><article>Teaser</article></div><div class=sidebar><article>Card</article></div>") == "The main text"
    assert bare("<div>Short post</div><div class=comments>A much longer talk of its readers</div>") == "Short post"


def test_parsing_deep_and_broken_pages():
    assert bare("<div>" * 50_000 + "deep" + "</div>" * 50_000) == "deep"
    assert bare("<div>" * 250 + "<aside>Beside</aside><p>text" + "</div>" * 250 + "<p>after") == "text\n\nafter"
    assert bare('<p title="a > b">x</p> 1 < 2 <a "' + '"x" ' * 5000).startswith("x")
    assert bare("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>mc^2</annotation></math> holds") == "E = mc2 holds"


def test_class_words_inside_articles_need_alignment(spark):
    """In an article, what one page marks by a class word stays; what most of the host's articles mark so goes, and so do adverts and readers' comments."""
    inner = "<h1 class='entry-header'>The Title</h1><section class='related-work'><p>Others {0}</section><div class='ad'>Buy {0}</div><p>Body {0} <span class='side'>aside</span><div class='notice'>Mind {0}</div><ul class='comments'><li>Nice {0}</ul>"
    page = lambda i, more="": (i, f"http://a.example/{i}", f"<body><article>{inner}{more}</article></body>".replace("{0}", f"n{i}"))
    alone = (50, "http://b.example/x", page(50)[2])
    once = page(3, "<div class='share'>A word on shares n3</div>")
    df = spark.createDataFrame([page(0), page(1), page(2), once, alone], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[0] == "Others n0\n\nBody n0 aside"  # the title is the same on all pages, notices are a slot of all articles
    assert got[3] == "Others n3\n\nBody n3 aside\n\nA word on shares n3"
    assert got[50] == "The Title\n\nOthers n50\n\nBody n50 aside\n\nMind n50"


def test_large_pages_are_pivots_and_all_template_is_empty(spark):
    filler = " ".join(f"w{i}" for i in range(30_000))
    pages = [(i, f"http://big.example/{i}", f"<body><p>Constant words</p><p>{filler} {i}</p></body>") for i in range(6)]
    assert len(pages[0][2]) > html_extract.PIVOT_BYTES
    pages += [(20 + i, f"http://same.example/{i}", f"<body><!--{i}--><p>Only footer text</p></body>") for i in range(4)]
    pages += [(30, "http://foot.example/1", "<body><div class='footer'>Small print</div></body>"), (31, "http://foot.example/2", "<body><div class='footer'>Small print 2</div></body>")]
    pages += [(40, "http://refs.example/", "<body><h1>T</h1><p>Text</p><ol>" + "".join(f"<li><a href='/{i}'>Author {i}, a long title of a paper, 2001</a>" for i in range(5)) + "</ol></body>")]
    pages += [(41, "http://tease.example/", "<body><article>Read more</article><div><p>The long body of the page itself, which no article holds</div></body>")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, hx int")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert all(got[i].text == f"{filler} {i}" and got[i].n_template == 1 for i in range(6))
    assert all(got[i].text == "" and got[i].n_chars == 0 and got[i].n_blocks == 1 for i in range(20, 24))
    assert got[30].text == got[31].text == "" and got[30].n_marked == 1
    assert got[40].text.count("Author") == 5
    assert got[41].text == "Read more\n\nThe long body of the page itself, which no article holds"


def random_tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice("stuv")
    return rng.choice(["div", "ul", "p"]), [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def as_html(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(as_html(t) if not isinstance(t, str) else f'<h2>{t}</h2>' for t in tree[1])}</{tree[0]}>"


def test_matching_is_that_of_a_plain_recursion(monkeypatch):
    """The weight of the best alignment, by recursion over first siblings; and the pairs have that weight."""

    def texts(node):
        return [node.text] if node.tag == "#" else [t for k in node.kids for t in texts(k)]

    def same_shape(a, b):
        return a.tag == b.tag and len(a.kids) == len(b.kids) and all(map(same_shape, a.kids, b.kids))

    def nodes(a):
        return 1 + sum(map(nodes, a.kids))

    def pair(a, b, with_texts):
        if a.tag != b.tag:
            return 0.0
        if same_shape(a, b):
            return nodes(a) + (0.5 * sum(map(str.__eq__, texts(a), texts(b))) if with_texts else 0.0)
        return 1.0 + lists(a.kids, b.kids, False)

    def lists(xs, ys, with_texts):
        best = [[0.0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i in range(len(xs)):
            for j in range(len(ys)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + pair(xs[i], ys[j], with_texts))
        return best[-1][-1]

    rng = random.Random(11)
    for cells in (html_extract.CELLS, 6):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(150):
            a, b = (read("<div>" + as_html(("div", [random_tree(rng, 3) for _ in range(rng.randint(1, 6))])) + "</div>") for _ in range(2))
            matcher = Matcher()
            assert matcher.structure(a.tree, b.tree) == pair(a.tree, b.tree, False)
            x, y = a.tree.kids[0].kids[0], b.tree.kids[0].kids[0]
            weight, pairs = matcher._align(x.kids, y.kids, a.texts, b.texts)
            assert weight == lists(x.kids, y.kids, True)
            pairs.sort()
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
            assert weight == sum(pair(x.kids[i], y.kids[j], True) for i, j in pairs)


def test_long_lists_and_repeats_are_aligned():
    rng = np.random.default_rng(4)
    items = [f"item {i}" for i in rng.integers(0, 10**6, 3000).tolist()]
    page = lambda xs: read("<ul>" + "".join(f"<li>{x}<p>{x}!" for x in xs) + "</ul>")
    kept = sorted(rng.choice(3000, 2600, replace=False).tolist())
    a, b = page(items), page(["new", *[items[i] for i in kept], "more"])
    found = html_extract.unchanged(Matcher(), a, b)
    assert len(found) >= 2 * 2600 and all(a.texts[i] == b.texts[j] for i, j in found)


def test_wrappers_and_unclosed_menus_keep_what_they_hold():
    assert bare('<body><form id="aspnetForm"><div><nav><a>Menu</a></nav><p>The whole page</p></div><footer>Foot</footer></form></body>') == "The whole page"
    assert bare("<form><article><p>Main</article></form><div>More</div>") == bare("<div role='form'><article><p>Main</article></div>") == "Main"
    assert bare("<body><nav><ul><li><a>Home</a></ul><article><p>Main</article><footer>Foot</footer>") == "Main"
    assert bare("<body><nav><ul><li><a>Home</a></ul><div><p>A text</div><footer>Foot</footer></body>") == "A text"
    assert bare("<body><nav><ul><li>A long menu of many words</ul></nav><p>Short</p><form><input> Find</form></body>") == "Short"
    assert bare("<div><p>The text of the page</div><aside><article>A teaser that is longer than the text</article></aside>") == "The text of the page"
    assert bare("<body><div hidden><article>Hidden</article></div><p>Seen</p></body>") == "Seen"


def test_main_around_articles_and_parts_named_by_answers():
    assert bare("<main><p>Intro</p><article><p>The body of it</article><p>Last</p></main><div>Other</div>") == "Intro\n\nThe body of it\n\nLast"
    assert bare("<article><p>Text<section id='reply'><p>On replies</section><div class='comments'>Said</div></article>") == "Text\n\nOn replies"


@pytest.mark.parametrize("html", ["<a " * 10**6, '<a ">" ' * 300_000, "<a<a" * 300_000, "<!--" * 300_000, "<a '" * 300_000 + ">", "< " * 500_000 + "<p>", '<a "' * 300_000 + "<?x"])
def test_markup_that_never_ends_is_read_in_linear_time(html):
    began = time.process_time()
    bare(html)
    assert time.process_time() - began < 4  # some tenths of a second; hours if it were quadratic


def test_small_hosts_have_no_pivots(spark):
    page = lambda i, words: f"<body><p>Same words</p><p>{words} {i}</p></body>"
    pages = [(i, f"http://two.example/{i % 2}", page(i % 2, "a")) for i in range(6)] + [(10 + i, f"http://three.example/{i}", page(i, "b")) for i in range(3)]
    got = {r.page_id: (r.text, r.n_template) for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == ("Same words\n\na 0", 0) and got[11] == ("b 1", 1)
