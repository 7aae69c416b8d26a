import random
import time

import pytest
from pyspark.sql import functions as F

from bandwright.llm import extract

SCHEMA = "page_id long, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { x("</p>") }</script></head><body class="has-sidebar">
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><div id='sideBar'>Side</div>
<article class="post has-comments"><header><h1 class="social-history">Head &amp; line</h1></header><p>One<br>two &eacute;&nbsp;x <b>bold</b><p>Three < four &am &copy
<ul><li>a<li>b</ul><div class="ad">Buy</div><form><p>Mail <label>here</label></p></form><table><tr><td>c<td>d <math>x</math></table>
<p><label>kept</label><section class="comments"><article class="comment"><p>First!</p></article></section></article>
<aside>Else</aside><footer>&copy; us</footer></body></html>"""


def text(html):
    nodes = extract.parse(html)
    return extract.blocks(*extract.unwrapped(nodes, None, None, extract.Matcher()))


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        (PAGE, ["Head & line", "One two é x bold", "Three < four &am ©", "a", "b", "c", "d x", "kept"]),
        ("", []), ("plain", ["plain"]), ("<p>open <b", ["open"]), ("a < b > c", ["a < b > c"]), ("<div><p>x</div>y", ["x", "y"]), ("<p hidden>h</p><p>s</p>", ["s"]), ("<!-- x", []),
        ("<main><p>m</main><p>o", ["m"]), ("<article></article><div class=ad>Buy</div>", []), ('<div id="content" class="no-sidebar"><h1>t</h1><p>one two</p></div><footer>f</footer>', ["t", "one two"]),
        ('<div class="sidebar-layout"><h1>t</h1><p>one two</p></div>', ["t", "one two"]), ("<div><ul><li><a href=x>Home</a><li><a>News</a></ul><p>some running text</p></div>", ["some running text"]),
    ],
)
def test_page(html, expected):
    assert text(html) == expected


def varied(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def site(rng, k, frame):
    body = [varied(rng, 20) for _ in range(rng.randrange(1, 5))]
    return frame.format("".join(f"<p>{b}</p>" for b in body), varied(rng, 3), k), "\n\n".join(body)


FRAMES = {
    # neutral names; a notice stands inside of the content, and the line below it varies
    "one.org": "<body><div class=a><p>All rights of this site</p></div><div class=b><div>Written for our readers</div>{0}</div><div class=c><p>{1}</p></div></body>",
    "two.org": '<body><article class="post has-comments"><div>Written for our readers</div>{0}</article><div><p>{1}</p></div></body>',
    "three.org": "<table><tr><td>Left<td><div id=x{2}>{0}</div><td>{1}</table>",
}


def test_wrapper_decides(spark):
    rng, pages, texts = random.Random(6), [], {}
    for host, frame in FRAMES.items():
        for _ in range(40):
            html, texts[len(pages)] = site(rng, len(pages), frame)
            pages.append((len(pages), f"http://{host}/x", html))
    n = len(pages)
    assert all("\n\n".join(text(html)) != texts[k] for k, _, html in pages[:80])  # not without the other pages
    copy = "<body><div class=a><p>All rights of this site</p></div><div class=b><p>copied text of many pages here</p></div></body>"
    pages += [(n + i, "http://copies.org", copy) for i in range(20)]  # copies make nothing constant
    pages += [(900, None, None), (901, "http://lone.org", "<p>lone</p>"), (901, "http://lone.org", "<p>lone</p>"), (None, "http://one.org/", ""), (902, "http://one.org/", "<h2>other</h2><p>layout of its own</p>")]
    df = spark.createDataFrame(pages, SCHEMA).withColumn("host", F.lit("h")).withColumn("layout", F.lit(1)).repartition(5)
    found = extract.extract(df).collect()
    assert len(found) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r for r in found}
    assert {k: by_id[k]["text"] for k in range(n)} == texts and all(by_id[k]["wrapped"] for k in range(n))
    assert all("copied text of many pages here" in by_id[n + i]["text"] for i in range(20))
    assert [by_id[k]["text"] for k in (900, 901, None, 902)] == ["", "lone", "", "other\n\nlayout of its own"]
    assert extract.extract(df.where("false")).count() == 0


def test_shuffled_references_give_the_same(spark, monkeypatch):
    rng = random.Random(1)
    pages = [(k, f"http://{host}/", site(rng, k, frame)[0]) for host, frame in FRAMES.items() for k in range(12)]
    df = spark.createDataFrame(pages, SCHEMA)
    one = sorted(map(tuple, extract.extract(df).collect()))
    monkeypatch.setattr(extract, "BROADCAST_CHARS", 10)
    assert sorted(map(tuple, extract.extract(df.repartition(3)).collect())) == one


def test_deep_wide_and_broken_pages():
    began = time.time()
    assert text("<div>" * 5000 + "<p>deep") == ["deep"] and text("x<a " * 40_000) == ["x"]
    text('<a href="x>' * 40_000), text("<b>" * 5000 + "</i>" * 5000 + "<p>" * 5000)
    m = extract.Matcher()
    deep, wide = ("<div>" * 5000 + "<p>x" + "</div>" * 5000), "<p>x<ul><li>y</ul>"
    assert len(m.pairs(extract.parse(deep)[0], extract.parse(deep + "<p>")[0])) >= 5002
    assert len(m.pairs(extract.parse(wide * 1500)[0], extract.parse("<p>z" + wide * 1400)[0])) == 2 + 3 * 1400
    assert time.time() - began < 30


def grown(rng, depth=0):
    tag = rng.choice(["div", "ul", "table"]) if depth else "html"
    node = extract.Node(tag, 0, None)
    if depth < 3:
        for _ in range(rng.randrange(4)):
            child = grown(rng, depth + 1)
            child.parent = node
            node.items.append(child)
    return node


def preorder(node):
    return [node, *(x for c in node.items for x in preorder(c))]


def largest(a, b):
    """Simple tree matching by trying every order-keeping mapping of the children."""
    if a.tag != b.tag:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), largest(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.elements, b.elements)


def test_matching_equals_exhaustive_search():
    rng, m = random.Random(3), extract.Matcher()
    for _ in range(150):
        a, b = grown(rng), grown(rng)
        extract.finish(preorder(a)), extract.finish(preorder(b))
        assert m.score(a, b) == largest(a, b)
        pairs = m.pairs(a, b)
        assert all(x.tag == y.tag for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) <= largest(a, b)
        assert all((x.place < u.place) == (y.place < v.place) for x, y in pairs for u, v in pairs if x is not u)


def test_long_lists_in_pieces(monkeypatch):
    rng, m = random.Random(4), extract.Matcher()
    a, b = (extract.parse("".join(rng.choice(["<p>x", "<p>y", "<h2>z</h2>", "<ul><li>u</ul>"]) for _ in range(90))) for _ in range(2))
    whole = [(x.place, y.place) for x, y in m.pairs(a[0], b[0])]
    monkeypatch.setattr(extract, "ROWS_APART", 7)
    assert [(x.place, y.place) for x, y in m.pairs(a[0], b[0])] == whole
