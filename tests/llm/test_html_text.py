"""Main text of pages; the style tree against a plain version."""

from __future__ import annotations

import math
import random
import re
import time
from collections import defaultdict
from html import unescape

import pytest

from fuzzmill.llm import html_text
from fuzzmill.llm.html_text import Page

PAGES = "page_id LONG, url STRING, html STRING, host STRING, low INT"


def text_of(html):
    return "\n".join(Page(html).kept({}, []))


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("just text & more &amp; &lt;b&gt; &eacute;&#233;&#xe9; &copy 5", "just text & more & <b> ééé © 5"),
        ("<p>a\n  b\t c<br>d</p><p>e", "a b c d\ne"),
        ("<article><h1>T &am</h1><p><b>one<br><p>two</p><p>thr<i>ee</i></article><footer>x</footer>", "T &am\none\ntwo\nthree"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes</p><script>never ends <p>x", "yes"),
        ("<title>t</title><!-- a > b --><p>1 < 2 <3</p><!-->ok<!--x", "1 < 2 <3\nok"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", "a\nb\nc\nd"),
        ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\nb\nc\nd"),
        ("<p title='a>b' data-x=\"<p>\">x</p>", "x"),
        ("<p title=\"never closed>x</p><p>y</p>", "x\ny"),
        ("<div>a</b></i></span>b</div>c</p>d", "ab\nc\nd"),
        ("<p>a <span class='ad'>buy</span> b <span hidden>x</span><button>go</button></p>", "a b"),
        ("<div style='display:none'>x</div><div aria-hidden='true'>y</div><p>z", "z"),
        ("<select><option>a<option>b</select><p>c", "c"),
        ("<P>UP</P><DIV>down", "UP\ndown"),
    ],
)
def test_parser(html, want):
    assert text_of(html) == want


CHROME = [
    "<nav><ul><li><a href='/x'>Menu</a></li></ul></nav>", "<header><a>Site</a><p>slogan</p></header>", "<footer>&copy; x</footer>",
    "<aside><h3>More</h3><p>links</p></aside>", "<div class='ad'>buy</div>", "<div class='cookie-notice'><p>we use</p></div>",
    "<form><p>Name <input name=a></p></form>", "<div id='comments'><article class='comment'><p>first!</p></article></div>",
    "<section class='user-comments'><p>nice</p></section>", "<ul class='breadcrumbs'><li>home</li></ul>", "<div role='banner'>b</div>",
    "<div class='siteSidebar'>s</div>", "<noscript><p>on</p></noscript>", "<p>stray words</p>", "<iframe><p>x</p></iframe>",
]


def test_chrome_around_and_inside_an_article_goes():
    rng = random.Random(1)
    body = "<h1>Head</h1><p>One.</p><blockquote>Two</blockquote><ul><li>Three</li></ul><p>Four</p>"
    inner = [c for c in CHROME if "stray" not in c and "<header" not in c]
    for _ in range(100):
        mark = rng.choice(["article", "main", "div class='post-content'"])
        cut = rng.choice([body, body.replace("<p>One", rng.choice(inner) + "<p>One") + rng.choice(inner)])
        page = "".join(rng.sample(CHROME, 5)) + f"<{mark}>{cut}</{mark.split()[0]}>" + "".join(rng.sample(CHROME, 5))
        assert text_of(f"<html><body class='has-sidebar'>{page}</body>") == "Head\nOne.\nTwo\nThree\nFour"


def test_wrappers_of_the_article_stay():
    assert text_of("<form id=f><div class='nav-layout'><article><header><h1>T</h1></header><p>x</p></article></div></form>") == "T\nx"
    assert text_of("<form><h1>T</h1><p>x</p></form><form><p>Mail</p></form>") == "T\nx"


def plain_importances(pages):
    """host, html -> {(host, node): (pages, importance)}"""
    looks, texts, above, seen = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int)), {}, defaultdict(int)
    for host, html in pages:
        page = Page(html)
        node, found = page.shape(host)
        for k, own in found.items():
            seen[host, k] += 1
            looks[host, k][frozenset(own)] += 1
        for i, t in set(page.blocks):
            texts[host, node[i]][t] += 1
            k, way = i, []
            while k >= 0:
                way.append(node[k])
                k = page.parent[k]
            above[host, node[i]] = way
    features = defaultdict(list)
    for (host, leaf), own in texts.items():
        m = seen[host, leaf]
        hs = [math.log(d) / math.log(m) if m > 1 else 0.0 for d in own.values()]
        for k in set(above[host, leaf]):
            features[host, k] += hs
    out = {}
    for key, m in seen.items():
        shown = -sum(c / m * math.log(c / m) / math.log(m) for c in looks[key].values()) if m > 1 else 1.0
        deep = html_text.DAMPING ** len(looks[key])
        hs = features[key]
        out[key] = (m, (1 - deep) * shown + deep * (1 - sum(hs) / len(hs)) if hs else shown)
    return out


def site(rng, host, n, div="div"):
    """Pages without any declared part: a menu, a teaser, the text."""
    out = []
    for i in range(n):
        words = " ".join(rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(30))
        paragraphs = "".join(f"<p>{words} {j} {i}</p>" for j in range(rng.randint(1, 4)))
        out.append((f"http://{host}/{i}", f"<{div}><p>Home</p><p>About</p></{div}><{div}><h2>Title {i}</h2>{paragraphs}</{div}><{div}>All rights</{div}>"))
    return out


def test_importances_equal_plain(spark):
    rng = random.Random(3)
    rows = [(f"h{rng.randint(0, 3)}", html) for _, html in site(rng, "x", 60) + site(rng, "x", 40, "section")]
    df = spark.createDataFrame([(f"https://u@H{h[1:]}:80/p", html) for h, html in rows], "url STRING, html STRING").repartition(4)
    got = {(r.host, r.node): (r.pages, r.importance) for r in html_text.importances(html_text.tree_counts(df)).collect()}
    want = plain_importances(rows)
    assert set(got) == set(want)
    for k, (m, imp) in want.items():
        assert got[k][0] == m and got[k][1] == pytest.approx(imp, abs=1e-9)


@pytest.mark.parametrize("few", [10**6, 0])
def test_style_tree_removes_what_repeats(spark, few):
    rng = random.Random(4)
    rows = site(rng, "a.example", 40) + site(rng, "b.example", 3)
    rows += [("http://c.example/1", "<article><h1>Same</h1><p>everywhere</p></article>")] * 30
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(rows)] + [(900, None, None, "x", 1), (901, None, "", "x", 1), (1, *rows[1], "x", 1)], PAGES)
    got = html_text.extract(df.repartition(3), few=few)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id >= 900:
            assert r.text == ""
        elif r.url.startswith("http://a"):  # the text only, whole
            want = re.findall(r"<(?:h2|p)>(.*?)</", rows[r.page_id][1])
            assert r.text == "\n".join(w for w in want if w not in ("Home", "About"))
        elif r.url.startswith("http://b"):  # too few pages to judge
            assert r.text.startswith("Home\nAbout") and r.text.endswith("All rights")
        else:  # shared by all pages, but all there is
            assert r.text == "Same\neverywhere"


def test_long_and_deep_pages():
    t = time.time()
    deep = Page("<div>" * 5000 + "x" + "<b>" * 20000 + "y" + "<p>z" * 5000)
    node, _ = deep.shape("h")
    assert len(set(node)) <= html_text.DEEPEST + 1
    assert deep.kept({}, node) == ["xy"] + ["z"] * 5000
    assert len(Page("<p>word &amp; more</p>" * 100_000).kept({}, [])) == 100_000
    assert time.time() - t < 60


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html_text.op11_html_extraction(spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        inner = re.search("<article>(.*)</article>", html[r.page_id], re.S).group(1)
        parts = [" ".join(unescape(re.sub("<br>|</?b>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p)


def test_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], PAGES)).collect() == []
