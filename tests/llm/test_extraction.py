"""Main text of hand-made pages, of every given page, and of odd ones."""

import html
import random
import re
import time

import pytest

from flowlens.llm import extraction, queries
from flowlens.llm.extraction import main_text

P = "This is a sentence of the article, long enough to count, with commas, and more."
Q = "Another paragraph follows here, which says something else, and says it at length."

CASES = {
    "plain text": ("just  some\n text &amp; more", "just some text & more"),
    "menus, adverts and footers go": (
        f"<body><div id=top-menu><a href=/a>A</a> <a href=/b>B</a></div><header><h1>Site</h1></header><div class='content'><h2>T</h2>"
        f"<p>{P}</p><div class=\"ad-slot\">Buy, buy, buy, now, it is cheap.</div><p>{Q}</p></div><div class=side-bar>x</div>"
        f"<div id='sidebar'><p>Read also, this, that, and that.</p></div><footer>© us</footer></body>", f"T\n\n{P}\n\n{Q}"),
    "scripts, styles, comments, forms": (
        f"<div><p>{P}</p><script>if (a < b) document.write('<p>no</p>')</script><style>p {{}}</style><!-- <p>no</p> -->"
        f"<form action=x><p>Your mail, please.</p><input><label>Mail</label></form><p>{Q}</p></div>", f"{P}\n\n{Q}"),
    "reader comments": (
        f"<article><h1>T</h1><p>{P}</p><p>{Q}</p><section id=comments><h2>Comments</h2><article class=comment><p>{P} {P} {P}</p>"
        f"</article></section></article><ol class=commentlist><li>{P}{P}</ol>", f"T\n\n{P}\n\n{Q}"),
    "cookie notice": (f"<div class='cookieNotice'><p>We use cookies, {P}</p></div><main><p>{P}</p></main>", P),
    "form round the page": (
        f"<form id=aspnet><div class=menu><a href=x>x</a></div><div><p>{P}</p><p>{Q}</p></div></form>", f"{P}\n\n{Q}"),
    "wrapper named after its sidebar": (
        f"<div class='with-sidebar'><div class=x><p>{P}</p><p>{Q}</p></div><div class=sidebar>{P}</div></div>", f"{P}\n\n{Q}"),
    "open tags": (f"<div><p><b>{P}<br>more<p>{Q}<ul><li>one<li>two, <i>three</ul>tail.</div>", f"{P} more\n\n{Q}\n\none\n\ntwo, three\n\ntail."),
    "unnamed menu": (
        f"<div><div><a href=1>One</a><a href=2>Two</a> <a href=3>Three</a></div><p>{P}</p><p>{Q} <a href=4>ref</a></p></div>",
        f"{P}\n\n{Q} ref"),
    "sections of one article": (
        f"<div id=main><h1>T</h1><div><h2>U</h2><p>{P}</p><p>{P}</p><p>{Q}</p></div><div><h2>V</h2><p>{Q}</p></div></div>",
        f"T\n\nU\n\n{P}\n\n{P}\n\n{Q}\n\nV\n\n{Q}"),
    "paragraph beside the best container": (f"<body><div><p>{P}</p><p>{Q}</p></div><p>The end, my friend, of all of this.</p>", f"{P}\n\n{Q}\n\nThe end, my friend, of all of this."),
    "character references": (
        "<p>a&nbsp;b &#233;&#xe9;&eacute; &lt;p&gt; &copy &notanentity; &#0; AT&T &amp;amp;</p>", "a b ééé <p> © ¬anentity; � AT&T &amp;"),
    "signs that are no tags": ("<p>a < b and c > d, 1 <2</p>", "a < b and c > d, 1 <2"),
    "quoted brackets": (f"<p title=\"x > y\" data-a='>'>{P}</p>", P),
    "tables": ("<table><tr><th>a<td>b<tr><td>c, d<td>e</table>", "a\n\nb\n\nc, d\n\ne"),
    "list and quote inside": (
        f"<article><p>{P}</p><blockquote>said, he</blockquote><ul><li>x</li><li>y</li></ul><pre>a\n  b</pre></article>",
        f"{P}\n\nsaid, he\n\nx\n\ny\n\na b"),
    "theme classes": (f"<body class='left-sidebar'><article class='post comments-open tag-social'><p>{P}</p></article>", P),
    "heading before the article": (f"<body><nav>n</nav><h1>T</h1><article><p>{P}</p></article></body>", f"T\n\n{P}"),
    "only menus": ("<nav><ul><li><a href=x>x</a></ul></nav><footer>f</footer>", ""),
    "headings only": ("<h1>A</h1><h2>B</h2>", "A\n\nB"),
    "unclosed script": (f"<p>{P}</p><script>var a = 1; <p>no</p>", P),
    "unclosed comment": (f"<p>{P}</p><!-- no", P),
    "upper case": (f"<BODY><NAV>n</NAV><DIV CLASS=AD>x, y, z</DIV><P>{P}</P></BODY>", P),
    "misnested link": (f"<div><p><a href=x>in</p><p>{P}</p><p>{Q}</p></div>", f"in\n\n{P}\n\n{Q}"),
    "adverts in a line": (f"<p>{P} <span class='ad x'>Buy!</span><i title='an ad is an ad'>Why</i> not.</p>", f"{P} Why not."),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    page, text = CASES[name]
    assert main_text(page) == text


def by_pattern(page):
    """The given pages have one <article> of headings and paragraphs."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    parts = [re.sub("</?b>", "", x.replace("<br>", " ")) for x in re.split("</?(?:h1|p)>", inner)]
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_every_given_page(spark, sf_dir, table):
    pages = {r["page_id"]: r for r in table("pages").collect()}
    found = queries.QUERIES["op11_extraction"](spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    for r in found:
        page = pages[r["page_id"]]
        assert r["text"] == (by_pattern(page["html"]) if page["html"] else "") and r["url"] == page["url"]
        assert r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    long_page = "<div>" + f"<p>{P}</p>" * 60_000 + "</div>"
    rows = [(1, None, None), (None, "u", f"<p>{P}</p>"), (None, None, None), (2, "u", ""), (3, "u", "  "), (4, "u", long_page),
            (5, "v", f"<p>{P}</p>"), (5, "v", f"<p>{P}</p>"), (6, "w", "<p>\U0001F914 \x00 é</p>"), (7, "x", "<" * 50_000)]
    df = spark.createDataFrame([(*r, "t", 1, "i") for r in rows], "page_id long, url string, html string, text string, n_chars long, id string")
    found = extraction.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in found) == sorted([
        (1, "", 0), (0, P[:9], len(P)), (0, "", 0), (2, "", 0), (3, "", 0), (4, P[:9], 60_000 * (len(P) + 2) - 2), (5, P[:9], len(P)),
        (5, P[:9], len(P)), (6, "\U0001F914 \x00 é", 5), (7, "<" * 9, 50_000)])
    assert extraction.extract(df.limit(0)).count() == 0


def test_time_grows_with_the_page():
    rng = random.Random(3)
    pieces = ["<div>", "</div>", "<p>", "</p>", "<b>", "</i>", "<a href=x>", "</a>", "<li>", "<td>", "</table>", "text, ", '="', "<!--", "&am"]
    for pick in (lambda: rng.choice(pieces[:-2]), lambda: "<div>", lambda: "<b><p>", lambda: '<a b="', lambda: "<p>x</div>"):
        start = time.perf_counter()
        main_text("".join(pick() for _ in range(40_000)))
        assert time.perf_counter() - start < 20
