import math
import random
import time

import pytest

from wavespark.llm import html

LONG = "This is a sentence of the article with enough words to count as text. " * 4


def page(body):
    return f"<!DOCTYPE html><html><head><title>Title</title><script>var a = '</p>';</script></head><body>{body}</body></html>"


MENU = '<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>'


@pytest.mark.parametrize(("body", "want"), [
    (f"{MENU}<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>Foot</footer>", ["Head", LONG, "Short."]),
    (f"<div id=wrap>{MENU}<div class='content'><h1>Head</h1><p>{LONG}<p>{LONG}</div><div class='sidebar'><p>{LONG}</p></div></div>", ["Head", LONG, LONG]),
    (f"<div class='ad'>Buy now</div><main><p>{LONG}</p><ul><li>One<li>Two</ul><aside>Aside</aside><form>Name <input></form></main>", [LONG, "One", "Two"]),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article><header>Site</header>", ["Head", LONG]),
    (f"<article><p>A &amp; B &lt;3 &#233;&nbsp;x<br>next {LONG}</p><pre>a\n  b</pre><table><tr><td>c1<td>c2</table></article>", [f"A & B <3 é x next {LONG}", "a b", "c1", "c2"]),
    (f"<div>{LONG}</div><p hidden>no</p><p style='display: none'>no</p><div role=dialog>no</div>", [LONG]),
    (f"<div><a href=x><h2>Linked head</h2></a><p><b>{LONG}<p>{LONG}</div>", ["Linked head", LONG, LONG]),
    ("Only text", ["Only text"]), ("", []), ("<!-- open", []), ("a < b and 3 > 2", ["a < b and 3 > 2"]), (f"<p>{LONG}</p><p title='>'>x</p><![CDATA[y]]>", [LONG, "x", "y"]),
    (f"<div class='page has-sidebar'><div class='post-header'><h1>Head</h1></div><p>{LONG}</p></div>", [LONG]), (f"<article><div class='post-header'><h1>Head</h1></div><p>{LONG}</p></article>", ["Head", LONG]),
    (f"<div class='sidebar-layout'><main><p>{LONG}</p></main><div class=sidebar>{LONG}</div></div>", [LONG]), (f"<div class='nav-open wrapper'><p>{LONG}</p><p>{LONG}</p></div><div class=menu>Menu</div>", [LONG, LONG]),
    (f"<p>{LONG}</p><ol class=commentlist><li><article class=comment>{LONG * 9}</article></ol>", [LONG]), (f"<p>{LONG}</p><article class='user-comment'>{LONG * 9}</article>", [LONG]),
    (f"<div class=shadow id=adventure><p>{LONG}</p></div>", [LONG]),
    (f"<div class=cookie-notice>{LONG}</div><div id=comments>{LONG}</div><p>{LONG}</p>", [LONG]),
])
def test_main_text(body, want):
    want = "\n".join(" ".join(x.split()) for x in want)
    assert html.main_text(page(body)) == want
    assert html.main_text(body) == want


def test_bare_text_beside_a_list():
    """Text that stands directly in containers above the densest block, and inline elements there, are kept in order."""
    items = "".join(f"<li>{LONG[:80]}</li>" for _ in range(5))
    text = "<br><br>".join(f"{LONG} <b>bold</b> {LONG}" for _ in range(4))
    bare = " ".join(f"{LONG} bold {LONG}".split())
    got = html.main_text(page(f"<div id=content>{text}<ul>{items}</ul>{LONG}<em>{LONG}</em></div>")).split("\n")
    assert got == [" ".join([bare] * 4), *[LONG[:80].strip()] * 5, " ".join(f"{LONG}{LONG}".split())]


TEASER = "<article>Short teaser of another page.</article>"


@pytest.mark.parametrize(("body", "want"), [
    (f"<div class='page ads-on'><article><p>{LONG}</p></article></div>", [LONG]),
    (f"<main class='promo-page'><p>{LONG}</p></main>", [LONG]),
    (f"<div class='login-page'><p>{LONG}</p></div><p class=ad>x</p>", [LONG]),
    (f"<div class='share-wrapper'>{MENU}<article><p>{LONG}</p><div class=share>Share</div></article></div>", [LONG]),
    (f"<form id=aspnetForm><input type=hidden>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div><footer>Foot</footer></form>", [LONG, LONG]),
    (f"<form><article><p>{LONG}</p><form>Name <input></form></article></form>", [LONG]),
    (f"<div aria-hidden=true><main><p>{LONG}</p></main></div><div>Loading</div>", [LONG]),
    (f"<div class='comments-open'><article><p>{LONG}</p></article><section class=comments><article class=comment>{LONG * 9}</article></section></div>", [LONG]),
    (f"<article><p>{LONG}</p></article><section id=comments><article>{LONG * 9}</article></section>", [LONG]),
    (f"<article><p>{LONG}</p></article><aside>{TEASER * 3}</aside><div class=related>{TEASER * 3}</div>", [LONG]),
    (f"<div class=content><p>{LONG}</p></div><div id=comments><p>{LONG * 9}</p></div>", [LONG]),
    (f"<p>{LONG}</p><nav><article>{LONG}</article></nav><article class=promo>{LONG[:50]}</article><main>{LONG}</main>", [LONG, LONG]),
])
def test_names_do_not_drop_the_article(body, want):
    assert html.main_text(page(body)) == "\n".join(" ".join(x.split()) for x in want)


def naive(root):
    """Density, density sum and best subtree of every node, each from a list of all that is below it."""
    kept = lambda n: [x for x in n.parts if isinstance(x, html.Node) and not x.drop]
    below = lambda n: [y for x in kept(n) for y in [x, *below(x)]]
    chars = lambda n: sum(len("".join(x.split())) for y in [n, *below(n)] for x in y.parts if isinstance(x, str))
    tags = lambda n: [x for x in below(n) if x.tag != html.RUN]

    def links(n):
        top = [n] if n.tag == "a" else [x for x in below(n) if x.tag == "a" and not any(y.tag == "a" and x in below(y) for y in below(n))]
        return sum(map(chars, top)), sum(len(tags(x)) for x in top) + sum(x is not n for x in top)

    share = links(root)[0] / (chars(root) or 1)

    def density(n):
        c, t, (lc, lt) = chars(n), len(tags(n)), links(n)
        if not c:
            return 0.0
        base = math.log(c / ((c - lc) or 1) * lc + share * c + math.e)
        return max(0.0, c / (t or 1) * math.log(max(c / (lc or 1) * (t or 1) / (lt or 1), 1e-9), base)) if base > 1 else c / (t or 1)

    def parts(n):
        return [z for x in kept(n) for z in ([x] if x.tag in html.BLOCK or x.tag == html.RUN else parts(x))]

    total = {id(n): sum(map(density, parts(n))) if parts(n) else density(n) for n in [root, *below(root)]}
    blocks = lambda n: [y for x in parts(n) for y in [x, *blocks(x)]]
    return {id(n): (density(n), total[id(n)], max(total[id(x)] for x in [n, *blocks(n)])) for n in [root, *below(root)]}


@pytest.mark.parametrize("seed", range(40))
def test_densities_by_brute_force(seed):
    rng = random.Random(seed)

    def grow(depth):
        out = []
        for _ in range(rng.randrange(1, 5)):
            tag = rng.choice(["div", "p", "ul", "a", "b", "section"])
            inner = grow(depth - 1) if depth and tag != "a" and rng.random() < 0.6 else " ".join("word" for _ in range(rng.randrange(12)))
            out.append(f"<{tag}>{inner}</{tag}>" + rng.choice(["", "loose text ", " "]))
        return "".join(out)

    root = html.parse(grow(3))
    nodes = html.measure(root)
    want = naive(root)
    for n in nodes:
        assert (n.density, n.sum, n.best.sum) == pytest.approx(want[id(n)]), n.tag


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(html, "SLICE", 1)
    rows = [(k, f"u{k}", f"<p>{LONG}{k}</p>" if k % 3 else None) for k in range(20)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert [(r["page_id"], r["url"], r["text"]) for r in found] == [(k, u, f"{LONG}{k}" if h else "") for k, u, h in rows]


def test_densities_by_hand():
    root = html.parse("<div><p>abcd <a>ef</a></p><p>gh</p></div>")
    nodes = {n.tag + str(n.c): n for n in html.measure(root)}
    assert (nodes["div8"].t, nodes["div8"].lc, nodes["div8"].lt) == (3, 2, 1)
    assert (nodes["p6"].c, nodes["p6"].t, nodes["p6"].lc) == (6, 1, 2) and nodes["p2"].density > 0
    import math

    base = math.log(6 / 4 * 2 + 2 / 8 * 6 + math.e)
    assert math.isclose(nodes["p6"].density, 6 / 1 * math.log(6 / 2 * 1 / 1, base))
    assert math.isclose(nodes["div8"].sum, nodes["p6"].density + nodes["p2"].density)


@pytest.mark.parametrize("source", ['<a "' * 50_000, "<div>" * 20_000 + "deep", "<" * 200_000, "<p" * 100_000, "<!--" * 50_000, "&amp" * 100_000, "<script>" * 20_000, "</b>" * 50_000, "<b>" * 3000 + "</i>" * 3000])
def test_odd_pages_take_linear_time(source):
    t = time.process_time()
    html.main_text(source)
    assert time.process_time() - t < 5


def test_generated_pages(spark, data):
    """On the generated pages the article element is the main text."""
    import html as entities
    import re

    for r in html.extract(spark.read.parquet(f"{data}/pages.parquet")).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", r["html"], re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(x for x in want if x) and r["n_chars"] == len(r["text"])


def test_awkward(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, ""), (2, None, page(f"<p>{LONG * 3000}</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    found = sorted(((r["page_id"] or 0, r["n_chars"]) for r in html.extract(df).collect()))
    assert found == [(0, 0), (1, 0), (1, 0), (2, len(LONG * 3000) - 1)] and html.extract(df.limit(0)).count() == 0
