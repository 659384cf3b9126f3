"""Main text of web pages by site style trees.

Each page is read into blocks of text with their style path (tags and classes from the root).
Pages of one host are merged: a style node is a path, and it knows on how many distinct pages it
occurs, how its contents are spread over them and how its parent's child sequences vary. With m
pages, a content found on d of them has entropy log_m(d); the content importance of a node is one
minus the mean entropy of its contents, the presentation importance of its parent is the entropy of
its child sequences to the base m, and the composite is GAMMA of the first and 1 - GAMMA of the
second. Branches of at least LEAST_PAGES pages whose composite importance is under LOW are removed
from every page of the host, as are branches whose tags, roles or class names say what they are
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, comments). Inside an
`article` or `main` a branch goes only if its content and its presentation importance are both
under LOW, so that passages which many pages quote stay where their node holds other texts too; an
article that would lose all its text keeps it unless the rest of the page has more. Names that are ordinary words
of articles too (`teaser`, `notice`, `share`, ...) remove nothing there by themselves: the tree confirms them if
the content importance of the node is under CONFIRMED. Adverts, forms and reader comments differ from page to page, so
their names hold without it. If the article parts (or else the main parts) hold half of the text that is left, the
page's text is those alone, with what stands before them in the main.
Numbers in class and id values don't tell nodes apart. A name is a whole class or id value, never a
part of one. If all article or main text of a page is in one such element inside a named branch, and
there is as much of it as of all text outside, the branches around it aren't noise, unless hidden.

A null html counts as empty and gives an empty text; a null url or one without a host counts as
host ''. Pages with equal html count once in the tree. Unclosed and stray tags are tolerated.
Rows are kept one to one, repeated ones too; extra columns are carried along by `extract`, which drops
`html` and adds `text` (or takes the place of a column so named).
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, fresh, narrow, read_table

GAMMA, LOW, LEAST_PAGES = 0.9, 0.25, 4
CONFIRMED = 0.5  #: content importance under which the tree confirms a doubtful name

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|xmp|noembed|noframes)(?![\w-])(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)[^>]*>",
    re.S | re.I,
)
#: one attribute after the other, so that names inside values and parts of names don't count
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: opening one of these ends an open one of the named kinds
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NOISE_TAGS = frozenset("nav footer aside form button select menu dialog head search object applet canvas audio video datalist fieldset".split())
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist respond replies consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
_NOISE_NAMES |= frozenset(
    "ad-banner ad-block ad-box ad-container ad-label ad-slot ad-unit ad-wrapper banner-ad google-ad cookie-banner cookie-bar cookie-consent cookie-notice gdpr-banner privacy-notice site-footer page-footer main-footer footer-links footer-nav site-nav site-navigation main-nav main-navigation main-menu nav-bar nav-links nav-menu side-nav top-nav top-bar skip-link skip-to-content breadcrumb-nav breadcrumb-list side-bar sidebar-left sidebar-right left-sidebar right-sidebar main-sidebar comment-form comment-list comment-section comments-area comments-list comments-section related-articles related-content related-links related-news related-posts recommended-articles recommended-posts share-bar share-buttons share-links social-bar social-buttons social-icons social-links social-media social-share newsletter-form newsletter-signup subscribe-form search-bar search-box search-form login-form promo-box sponsored-content".split()
)
#: words that name parts of articles as well: inside an article or main the tree has to confirm them
_DOUBTFUL_NAMES = frozenset("banner disclaimer notice notices promotion recommended related search share sharing skip social teaser widget".split())
#: what else a name with `comment` or `comments` in it may have, to be a branch of reader comments
_COMMENT_PARTS = frozenset("comment comments user users reader readers visitor visitors post article list section area form thread threads wrapper box container item items block feed".split())
_HEADER_NAMES = frozenset("header site-header page-header main-header top-header".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_KEEP_TAGS = frozenset("html body article main".split())


def _of_comments(name: str) -> bool:
    parts = re.split("[-_]+", name)
    return len(parts) > 1 and not {"comment", "comments"}.isdisjoint(parts) and _COMMENT_PARTS.issuperset(parts)


def _attributes(attr: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if attr and not attr.isspace():
        for m in _ATTR.finditer(attr):
            out.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())  # of equal names the first counts
    return out


def blocks(page: str) -> list[tuple[str, str, int, int, str]]:
    """(path, text, noise, part, parent) of each block of text; noise: 1 by name, 2 by a doubtful name in an article or main, else 0; part: 2 in an article, 1 in a main, else 0."""
    out, held = _parse(page)
    if len(held) == 1 and held[0] and not any(b[3] and b[2] != 1 for b in out):
        inner, outside = (sum(len(b[1]) for b in x) for x in ([b for b in out if b[3]], [b for b in out if b[2] != 1]))
        if inner and inner >= outside:
            out, _ = _parse(page, held[0])
    return out


def _parse(page: str, spared: frozenset[int] = frozenset()) -> tuple[list[tuple[str, str, int, int, str]], list[frozenset[int]]]:
    """Blocks, and for each outermost article or main in a noise branch where the elements around it start (none if it is hidden).

    Elements that start at `spared` places aren't noise by name.
    """
    out, held, buffer, at = [], [], [], 0
    # tag, path, noise (1, or 2 inside a line), part, hidden, place, doubtful
    stack: list[tuple[str, str, int, int, bool, int, bool]] = [("", "", 0, 0, False, -1, False)]

    def flush() -> None:
        if buffer:
            text = " ".join(_html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                i = len(stack) - 1
                while i and stack[i][0] not in _BLOCK:
                    i -= 1
                out.append((stack[i][1], text, 1 if stack[i][2] else 2 * stack[i][6], stack[i][3], stack[max(i - 1, 0)][1]))

    def close(to: int) -> None:
        """Ends the elements from stack position `to` on."""
        if any(x[0] in _BLOCK for x in stack[to:]):
            flush()
        del stack[to:]

    for m in _TOKEN.finditer(page):
        if m.start() > at and stack[-1][2] != 2:
            buffer.append(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            buffer.append(_html.escape(m["cdata"]))
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            found = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if found:
                close(found)
            elif tag in _BLOCK:
                flush()
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            ends = ("p",) if tag not in _ENDS else ("p", *_ENDS[tag])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        if tag in _VOID:
            continue
        a = _attributes(m["attr"] or "")
        _, path, noise, part, hidden, _, doubtful = stack[-1]
        names = set(f"{a.get('class', '')} {a.get('id', '')}".split())
        role, outer = a.get("role", ""), part
        hidden = hidden or (tag not in _KEEP_TAGS and ("hidden" in a or a.get("aria-hidden") == "true"))
        part = max(part, 2 if tag == "article" or role == "article" or "articlebody" in a.get("itemprop", "") else 1 if tag == "main" or role == "main" else 0)
        if tag not in _KEEP_TAGS and not noise:
            called = {n for n in names if n in _NOISE_NAMES or _of_comments(n)}
            named = tag in _NOISE_TAGS or bool(called - (_DOUBTFUL_NAMES if part else set())) or role in _NOISE_ROLES
            doubtful = doubtful or (not named and bool(called) and tag in _BLOCK)
            named = named or (part < 2 and (tag == "header" or bool(names & _HEADER_NAMES)))
            noise = (1 if tag in _BLOCK else 2) if hidden or (named and m.start() not in spared) else 0
        elif noise == 2 and tag in _BLOCK:
            noise = 1
        if noise and part and not outer:
            held.append(frozenset() if hidden else frozenset(x[5] for x in stack))
        label = re.sub(r"\d+", "0", "." + ".".join(sorted(names))) if names else ""
        stack.append((tag, f"{path}>{tag}{label}", noise, part, hidden, m.start(), doubtful))
    if at < len(page) and stack[-1][2] != 2:
        buffer.append(page[at:])
    flush()
    return out, held


def node_of(path: str, part: int) -> str:
    """The name of a style node: inside an article or main it has a plus in front."""
    return f"+{path}" if part else path


Piece = tuple[int, str, int, int]  #: hash of a block's node, its text, its noise and its part, as in `blocks`


def choose(pieces: list[Piece], low: frozenset[int] = frozenset()) -> str:
    """The article's blocks, joined by line feeds; `low`: nodes of low importance on the page's host."""
    size = lambda found: sum(len(b[1]) for b in found)
    found = [b for b in pieces if b[2] != 1]
    left = [b for b in found if b[0] not in low]
    if not any(b[3] for b in left):
        inner = [b for b in found if b[3]]
        left = inner if size(inner) >= size(left) else left
    for part in (2, 1):
        inner = [b for b in left if b[3] >= part]
        if inner and 2 * size(inner) >= size(left):
            # What stands in the main before its first article is its title and introduction.
            first = next(i for i, b in enumerate(left) if b[3] >= part)
            left = [b for b in left[:first] if b[3]] + [b for b in left[first:] if b[3] >= part]
            break
    return "\n".join(b[1] for b in left)


def main_text(page: str, low: frozenset[str] = frozenset()) -> str:
    """Main text of one page; `low`: names of nodes of low importance."""
    return choose([(_hash(node_of(path, part)), text, noise, part) for path, text, noise, part, _ in blocks(page)], frozenset(map(_hash, low)))


# --- the style tree ----------------------------------------------------------------------------------------------


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


BLOCKS = "struct<texts:array<string>,nodes:array<long>,styles:array<long>,noise:array<int>,parts:array<int>,kinds:array<int>>"
INNER, OUTER, DOUBTFUL = range(3)  #: kinds of style nodes: in an article or main, elsewhere, doubtfully named


def _parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each page's blocks as parallel arrays; a block's style is its parent's sequence of distinct children."""
    for column in pages:
        rows = []
        for page in column:
            found = blocks(page)
            children: dict[str, dict[str, None]] = {}
            for path, _, _, _, parent in found:
                children.setdefault(parent, {})[path] = None
            styles = {parent: _hash("|".join(paths)) for parent, paths in children.items()}
            rows.append(([b[1] for b in found], [_hash(node_of(b[0], b[3])) for b in found], [styles[b[4]] for b in found], [b[2] for b in found], [b[3] for b in found], [DOUBTFUL if b[2] == 2 else INNER if b[3] else OUTER for b in found]))
        yield pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=object) for i, k in enumerate(("texts", "nodes", "styles", "noise", "parts", "kinds"))})


def _chosen(columns: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
    for found, low in columns:
        rows = zip(found["nodes"], found["texts"], found["noise"], found["parts"], low, strict=True)
        yield pd.Series([choose(list(zip(map(int, n), t, x, p, strict=True)), frozenset(() if w is None else map(int, w))) for n, t, x, p, w in rows], dtype=object)


def tree(parsed: DataFrame) -> DataFrame:
    """(host, node, kind, pages, content, style): both importances of every style node, from (host, page, found)."""
    # Pages with equal html count once. A page has one style for a node, so the counts of a node's styles add up to its pages.
    once = parsed.select("host", "page", F.arrays_zip("found.nodes", "found.kinds", "found.styles", F.transform("found.texts", lambda t: F.xxhash64(t))).alias("x")).dropDuplicates(["host", "page"])
    x = once.select("host", F.transform("x", lambda b: F.struct(b["nodes"].alias("node"), b["kinds"].alias("kind"), b["styles"].alias("style"), b["3"].alias("content"))).alias("x"))
    node, d = ["host", "node", "kind"], F.col("d").cast("double")
    part = lambda *names: x.select("host", F.explode(F.array_distinct(F.transform("x", lambda b: F.struct(*(b[n].alias(n) for n in names))))).alias("b")).select("host", "b.*")
    styles = part("node", "kind", "style").groupBy(*node, "style").agg(F.count("*").alias("d")).groupBy(*node).agg(F.sum("d").alias("pages"), F.sum(d * F.log(d)).alias("x"))
    contents = part("node", "kind", "content").groupBy(*node, "content").agg(F.count("*").alias("d"))
    contents = contents.groupBy(*node).agg(F.avg(F.log(d)).alias("h"))
    m = F.log(F.greatest("pages", F.lit(2)).cast("double"))
    shared = lambda x: F.when(F.col("pages") < 2, 1.0).otherwise(x)
    return styles.join(contents, node).select(*node, "pages", shared(1 - F.col("h") / m).alias("content"), shared(1 - F.col("x") / F.col("pages") / m).alias("style"))


def extract(pages: DataFrame, text: str = "text") -> DataFrame:
    """`pages` without `html`, with the main text of each. Pages are parsed once; what was parsed is a scratch table."""
    host, page, found, gone = (fresh(pages, f"_{x}") for x in ("host", "page", "found", "low"))
    scratch, source = Scratch(pages.sparkSession, "html"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.withColumns({host: host_of(), page: F.xxhash64(source), found: F.pandas_udf(_parsed, BLOCKS)(source)}).drop("html")
    parsed = scratch.keep(keyed, "parsed")
    nodes = tree(parsed.select(F.col(host).alias("host"), F.col(page).alias("page"), F.col(found).alias("found")))
    content, style = F.col("content"), F.col("style")
    unimportant = F.when(F.col("kind") == OUTER, GAMMA * content + (1 - GAMMA) * style < LOW).when(F.col("kind") == DOUBTFUL, content < CONFIRMED).otherwise(F.greatest(content, style) < LOW)
    low = scratch.keep(nodes.where((F.col("pages") >= LEAST_PAGES) & unimportant).groupBy("host").agg(F.sort_array(F.collect_set("node")).alias("low")), "low")
    size = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)) + F.count("*")).first()[0]  # nodes and hosts: what a broadcast would hold
    joined = parsed.join(narrow(low.toDF(host, gone), size), host, "left")
    return joined.withColumn(text, F.pandas_udf(_chosen, "string")(F.col(found), F.col(gone))).drop(host, page, found, gone)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
