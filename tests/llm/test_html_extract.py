import html
import math
import random
import re
from collections import Counter

import pytest

from helixframe.llm import html_extract as H

PAGE = """<!DOCTYPE html><html><head><title>No &lt;p&gt;</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header class="site"><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<main><article><h1>T &lt;b&gt; &eacute;&#33;</h1><p>One<br>two  <b>three</b> <span class="ad">BUY</span> four<p title="a>b">Five
six<form><p>sub</p></form><blockquote>q</blockquote><!-- <p>x</p> --><table><tr><td>a<td>b</table><section class="comments"><article><p>c</p></article></section></article></main>
<aside>s</aside><footer>f</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE) == "T <b> é!\nOne two three four\nFive six\nq\na\nb"


@pytest.mark.parametrize("page,text", [("", ""), ("plain &amp; simple", "plain & simple"), ("<p>open", "open"), ("</div></p>x</b>", "x"), ("<script>never closed <p>y", ""), ("<p>a<!-- never closed", "a"), ('<p class="x>never closed', "never closed"), ("<div><p>a</div>b", "a\nb"), ("a<br/>b&nbsp;c", "a b c"), ("<p>&am &bogus; &#x41;</p>", "&am &bogus; A")])
def test_broken_markup(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-footer", "ad-free", "social-science", "sidebar", "search-form x"])
def test_wrappers_of_the_article_are_not_noise(name):
    page = f'<div class="{name}"><div id=widget><article><p>Text</p><div class="ad">buy</div><section id="related-work"><p>Prior</p></section></article></div></div>'
    assert H.main_text(page) == "Text\nPrior"


def test_named_branches_still_go():
    page = '<div class="site-header">H</div><div class="ad x">A</div><p>Real text of the page</p><div class="comments"><article>c</article></div><div hidden><article>Not shown, however long it is</article></div>'
    assert H.main_text(page) == "Real text of the page"
    assert H.main_text('<form><main><p>Text</p><nav>n</nav></main></form><p>x</p>') == "Text"


def test_low_importance_branches_go_and_quoted_passages_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<div class=body><p>Text {i} of its own</p></div><div class=strip><p>Same on every page</p></div>") for i in range(12)]
    rows += [(100 + i, "http://g.example/", f"<article><p>Quoted by all</p><p>Text {i}</p></article>") for i in range(8)]
    rows += [(200, None, "<p>alone</p>"), (201, "nonsense", None), (202, "http://h.example/", "")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, _host string")
    out = H.extract(pages)
    got = {r.page_id: r.text for r in out.collect()}
    assert got[3] == "Text 3 of its own" and got[104] == "Quoted by all\nText 4"
    assert (got[200], got[201], got[202]) == ("alone", "", "")
    assert "_host" in out.columns and H.extract(pages.limit(0)).count() == 0


def test_boilerplate_inside_articles_goes_and_a_card_is_no_article(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"http://a.example/{i}", f"<article id=post-{i}><p>Text {i} of its own</p><p>Quoted by all</p><div class=strip><p>Same on every page</p></div></article>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<div class=body><p>Real text {i} {words}</p></div><article class=card><p>Card {i}</p></article>") for i in range(6)]
    rows += [(200 + i, f"http://c.example/{i}", f"<!-- {i} --><main><p>Mirrored</p></main>") for i in range(6)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 3 of its own\nQuoted by all"
    assert got[104] == f"Real text 4 {words}\nCard 4"
    assert got[205] == "Mirrored"


def plain_tree(pages):
    """host -> nodes of low importance, by definition, from whole pages in memory."""
    hosts, low = {}, {}
    for host, page in dict.fromkeys(pages):
        hosts.setdefault(host, []).append(H.blocks(page))
    for host, found in hosts.items():
        nodes = {}
        for page in found:
            for path, _, _, part, parent in page:
                style = tuple(dict.fromkeys(b[0] for b in page if b[4] == parent))
                nodes.setdefault(H.node_of(path, part), []).append((style, frozenset(b[1] for b in page if H.node_of(b[0], b[3]) == H.node_of(path, part)), id(page)))
        for node, seen in nodes.items():
            seen = list({x[2]: x for x in seen}.values())
            m = len(seen)
            if m < H.LEAST_PAGES:
                continue
            spread = [sum(c in x[1] for x in seen) for c in set().union(*(x[1] for x in seen))]
            content = 1 - sum(math.log(d) for d in spread) / len(spread) / math.log(m)
            styles = Counter(x[0] for x in seen)
            style = -sum(d / m * math.log(d / m) for d in styles.values()) / math.log(m)
            if (max(content, style) if node[0] == "+" else H.GAMMA * content + (1 - H.GAMMA) * style) < H.LOW:
                low.setdefault(host, set()).add(node)
    return low


def test_pages_without_article_depend_on_the_tree(spark):
    r, rows = random.Random(3), []
    for h in range(4):
        strips = [f"<div class=s{'abc'[j]}><p>Strip {j} of host {h}</p></div>" for j in range(3)]
        for i in range(r.choice([3, 9, 14])):
            body = "".join(f"<p>Own sentence {r.random()} of {i}</p>" for _ in range(r.randint(1, 4)))
            some = [x for x in strips if r.random() < 0.9]
            page = "".join(some[:1]) + f"<div class=body>{body}</div>" + "".join(some[1:])
            rows.append((len(rows), f"https://h{h}.example/{i}", page if r.random() < 0.8 else f"<article>{page}</article>"))
    rows += [(1000, *rows[0][1:]), (1001, *rows[1][1:]), (1002, "https://h0.example/long", "<div class=body>" + "<p>Very long</p>" * 2_000 + "</div>")]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, _found string")).collect()}
    low = plain_tree([(u.split("/")[2], page) for _, u, page in rows])
    assert got == {i: H.main_text(page, frozenset(low.get(u.split("/")[2], ()))) for i, u, page in rows}
    assert sum("Strip" in page and "Strip" not in got[i] for i, _, page in rows) > 10
    assert got[0] == got[1000] and got[1002].count("Very long") == 2_000


@pytest.mark.parametrize("page,text", [('<div class="layout no-sidebar"><p>Real text</p></div>', "Real text"), ('<p title="a hidden gem">Real text</p>', "Real text"), ('<article><p data-id="ad">Real</p><p>b</p></article>', "Real\nb"), ('<article><p class="search-term">Real</p></article>', "Real"), ("<main><p>intro outside</p><article><p>teaser</p></article></main>", "intro outside\nteaser"), ('<p data-class="ad" aria-label="class=ad">Real</p>', "Real"), ('<p class="ad">x</p><p>Real</p>', "Real"), ("<p hidden>x</p><p>Real</p>", "Real"), ("<p class=ad>x</p><p>Real</p>", "Real")])
def test_attributes_are_told_apart(page, text):
    assert H.main_text(page) == text


def test_query_on_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in H.op4_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", a))
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


@pytest.mark.parametrize(
    "page,text",
    [
        ('<article><p class="teaser">Lead paragraph of the article.</p><p>Body.</p></article>', "Lead paragraph of the article.\nBody."),
        ('<article><p>Before.</p><p class="notice">Safety notice of recall in article.</p></article>', "Before.\nSafety notice of recall in article."),
        ('<main><div class="share">Share prices fell</div><p>on Monday</p></main>', "Share prices fell\non Monday"),
        ('<article><p>Text of the article</p><div class="user-comments"><p>reader comment</p></div><ol id="reader_comments_list"><li>another</ol></article>', "Text of the article"),
        ("<main><h1>Title</h1><p>Intro</p><article><p>An article that holds much more than half</p></article><p>Read on elsewhere</p></main>", "Title\nIntro\nAn article that holds much more than half"),
        ('<div class="share">Share this</div><p>Text of its own</p>', "Text of its own"),
        ('<article><p>Text</p><p class="comment-worthy">kept</p></article>', "Text\nkept"),
    ],
)
def test_names_inside_articles(page, text):
    assert H.main_text(page) == text


def test_the_tree_confirms_doubtful_names(spark):
    page = lambda i, inner: f"<article><p>Text {i} of its own</p>{inner}<p>End {i}</p></article>"
    rows = [(i, f"http://a.example/{i}", page(i, "<p class=teaser>Subscribe for more</p>")) for i in range(8)]  # says the same everywhere: goes
    rows += [(100 + i, f"http://b.example/{i}", page(i, f"<p class=teaser>Lead {i}</p>")) for i in range(8)]  # says its own: stays
    rows += [(200 + i, f"http://c.example/{i}", page(i, "<p class=teaser>Subscribe for more</p>")) for i in range(3)]  # too few pages to tell: stays
    rows += [(300 + i, f"http://d.example/{i}", page(i, f"<div class=share><p>{'Share this' if i % 4 else 'Share prices fell'}</p></div>")) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Text {i} of its own\nEnd {i}" for i in range(8))
    assert all(got[100 + i] == f"Text {i} of its own\nLead {i}\nEnd {i}" for i in range(8))
    assert all("Subscribe" in got[200 + i] for i in range(3))
    assert all("Share" not in got[300 + i] for i in range(8))


def test_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>x</p>", "kind", 3, "t")], "page_id long, url string, html string, node string, _low int, text string")
    got = H.extract(pages).collect()
    assert [(r.page_id, r.node, r._low, r.text) for r in got] == [(1, "kind", 3, "x")]
    assert H.extract(pages.limit(0)).collect() == []
