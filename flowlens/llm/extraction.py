"""Main text of web pages by tree scoring.

A tolerant reader turns a page into block elements and runs of text. Runs pass points for
length and commas to the elements round them; points are discounted by link density; the
element with most of them, with siblings like it, is the article.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.rows import col

# Fixed values of HTML: elements without content, with raw content, those that end an open paragraph, and so on.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp noscript template".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("body div section article main center details header td".split())
BLOCK = LEAF | CONTAINER | frozenset(
    "html head aside blockquote dialog dir dl fieldset figure footer form hgroup menu nav ol search select button object svg "
    "audio video canvas datalist table tbody tfoot th thead tr ul".split())
#: Opening one of these ends the open ones named, up to the element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}), "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot"}, {"table"}), "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html".split())

#: Elements and roles that are never part of an article.
NEVER = frozenset(
    "head nav aside footer menu dialog search select button datalist object svg audio video canvas fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that name something beside the article.
BESIDE = frozenset("""
    ad ads adbox adslot advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo
    promos promotion promoted banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs topbar masthead header
    footer sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices notification notifications
    alert alerts popup popups modal overlay lightbox paywall disclaimer comment comments commentlist discussion disqus respond
    replies reply responses related recommended recommendations share sharing social newsletter subscribe subscription signup
    login searchform pagination pager toolbar copyright
""".split())
#: Those of them that hold other people's articles; the rest may also name the layout of an element round the article.
OTHERS = frozenset(
    "comment comments commentlist discussion disqus respond replies reply responses related recommended recommendations".split())
ADVERT = frozenset("ad ads advert advertisement advertising sponsor sponsored promo".split())
OWN = frozenset("article entry post story content".split())
NEGATED = frozenset("has with no without show hide".split())

TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+)(?:>|\Z)""", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
COMMAS = re.compile("[,،、，]")
SENTENCE_END = re.compile(r"""[.!?…。！？]["'”’»)]*\Z""")


class Run(NamedTuple):
    """White-space-normalised text between two block boundaries, in its nearest block element."""

    owner: int
    text: str
    linked: int
    links: int


def _beside_word(name: str, attributes: str) -> str:
    """The word in an element's class, id or role that names something beside the article; '' if none does."""
    for key, *values in ATTRIBUTE.findall(attributes):
        value = unescape(next((v for v in values if v), ""))
        if key.lower() == "role":
            if value.strip().lower() in ROLES:
                return value.strip().lower()
            continue
        for item in value.split():
            if name == "article":  # themes list a post's features in its class
                if item.lower() in BESIDE:
                    return item.lower()
                continue
            words = [w.lower() for w in WORD.findall(item)]
            for at, word in enumerate(words):
                if word not in BESIDE:
                    word += "".join(words[at + 1 : at + 2])  # side-bar, bread-crumb
                if word in BESIDE and not (at and words[at - 1] in NEGATED) and not (word == "header" and OWN & set(words)):
                    return word
    return ""


class Page:
    """Block elements of a page in order, with their parents, and the runs of text in them."""

    def __init__(self, html: str):
        self.name, self.parent, self.beside, self.runs = ["html"], [-1], [""], []
        self._open: list[tuple[str, int]] = [("html", 0)]  # inline elements have the number -1, skipped blocks -2, both -3
        self._count, self._parts, self._skips = Counter(html=1), [], 0
        self._linked = self._links = 0
        at = 0
        while found := TAG.search(html, at):
            self._text(html[at : found.start()])
            at = found.end()
            if not found[2]:
                continue
            name = found[2].lower()
            if found[1]:
                self._end(name)
            else:
                self._start(name, found[3])
                if name in RAW:
                    end = RAW_END[name].search(html, at)
                    at = end.start() if end else len(html)
        self._text(html[at:])
        self._close_run()

    def _text(self, text: str) -> None:
        if text and not self._skips:
            text = unescape(text)
            self._parts.append(text)
            if self._count["a"]:
                self._linked += sum(map(len, text.split()))

    def _close_run(self) -> None:
        text = " ".join("".join(self._parts).split())
        if text:
            owner = next(node for _, node in reversed(self._open) if node >= 0)
            self.runs.append(Run(owner, text, self._linked, self._links))
        self._parts, self._linked, self._links = [], 0, 0

    def _pop(self) -> None:
        name, node = self._open[-1]
        if node not in (-1, -3):
            self._close_run()
        self._open.pop()
        self._count[name] -= 1
        self._skips -= node <= -2

    def _pop_to(self, depth: int) -> None:
        while len(self._open) > depth:
            self._pop()

    def _find(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        """The depth of the innermost open element of these names, unless one of ``stop`` is further in; else 0."""
        if any(self._count[n] for n in names):
            for depth in range(len(self._open) - 1, 0, -1):
                name = self._open[depth][0]
                if name in names:
                    return depth
                if name in stop:
                    break
        return 0

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name == "hr":
                self._close_run()
            elif name == "br":
                self._text("\n")
            return
        if name in RAW:
            return
        if name == "html" or name == "body" and self._count["body"]:
            return
        block = name in BLOCK or "-" in name
        if not block:
            names = " ".join("".join(values) for key, *values in ATTRIBUTE.findall(attributes) if key.lower() != "role") if attributes else ""
            skipped = name == "label" or not ADVERT.isdisjoint(names.lower().split())
            if name == "a":
                if depth := self._find({"a"}, BLOCK):
                    self._pop_to(depth)
                self._links += not self._skips
            if skipped and not self._skips:
                self._text(" ")
            self._open.append((name, -3 if skipped else -1))
            self._count[name] += 1
            self._skips += skipped
            return
        self._close_run()
        if depth := self._find({"p"}, SCOPE | {"button", "object"}):
            self._pop_to(depth)
        if name in HEADING and self._open[-1][0] in HEADING:
            self._pop()
        if name in ENDS:
            names, stop = ENDS[name]
            while depth := self._find(names, stop):
                self._pop_to(depth)
        self._count[name] += 1
        if name in NEVER or name == "header" and not (self._count["article"] or self._count["main"]):
            self._open.append((name, -2))
            self._skips += 1
            return
        node = -1
        for _, node in reversed(self._open):
            if node >= 0:
                break
        self._open.append((name, len(self.name)))
        self.name.append(name)
        self.parent.append(node)
        plain = name in ("body", "main") or not attributes
        self.beside.append("form" if name == "form" else "" if plain else _beside_word(name, attributes))

    def _end(self, name: str) -> None:
        if name == "br":
            self._text("\n")
        if name in ("html", "body") or not self._count[name]:
            if name in BLOCK:
                self._close_run()
            return
        block = name in BLOCK or "-" in name
        if depth := self._find({name}, SCOPE - {name} if block else BLOCK):
            self._pop_to(depth)


def main_runs(page: Page) -> list[Run]:
    """The runs of the article, in page order."""
    n, runs = len(page.name), page.runs
    whole = [0] * n
    holds = [name in ("article", "main") and not beside for name, beside in zip(page.name, page.beside)]
    for run in runs:
        whole[run.owner] += len(run.text)
    for node in range(n - 1, 0, -1):
        whole[page.parent[node]] += whole[node]
        holds[page.parent[node]] |= holds[node]
    dropped = [False] * n
    for node in range(1, n):
        wraps = holds[node] and page.beside[node] not in OTHERS or page.beside[node] == "form" and 2 * whole[node] > whole[0]
        dropped[node] = dropped[page.parent[node]] or page.beside[node] != "" and not wraps
    runs = [r for r in runs if not dropped[r.owner]]

    size, linked, links = [0] * n, [0] * n, [0] * n
    for run in runs:
        size[run.owner] += len(run.text)
        linked[run.owner] += run.linked
        links[run.owner] += run.links
    for node in range(n - 1, 0, -1):
        for sums in (size, linked, links):
            sums[page.parent[node]] += sums[node]
    density = [l / s if s else 0.0 for l, s in zip(linked, size)]
    for node in range(1, n):  # menus without a name
        menu = links[node] >= 3 and density[node] >= 0.75 and page.name[node] not in ("body", "article", "main")
        dropped[node] = dropped[page.parent[node]] or dropped[node] or menu
    runs = [r for r in runs if not dropped[r.owner]]
    if not runs:
        return []

    points = [0.0] * n
    for run in runs:
        if page.name[run.owner] in HEADING:
            continue
        given = 1 + len(COMMAS.findall(run.text)) + len(run.text) / 100
        node, level = run.owner, 0
        while node >= 0 and level < 5:
            if page.name[node] in CONTAINER or "-" in page.name[node] or node == 0:
                points[node] += given / (1, 2, 6, 9, 12)[level]
                level += 1
            node = page.parent[node]
    score = [p * (1 - d) for p, d in zip(points, density)]
    best = max(range(n), key=lambda node: (score[node], node))
    top = score[best]
    if not top:  # headings only
        best = 0
    around, node = [], best
    while node >= 0:
        around.append(node)
        node = page.parent[node]
    best = next((a for a in around if page.name[a] == "article"), next((a for a in around if page.name[a] == "main"), best))

    heads, kept = set(), {best}
    parent = page.parent[best]
    for run in runs:
        node = run.owner
        while node >= 0 and page.name[node] not in ("h1", "h2"):
            node = page.parent[node]
        if node >= 0:
            while node >= 0 and node != best:
                node = page.parent[node]
            if node == best:
                heads.add(best)
    if parent >= 0:
        for node in range(1, n):
            if page.parent[node] != parent or dropped[node] or not size[node] or density[node] >= 0.25:
                continue
            if page.name[best] in ("article", "main"):
                like = page.name[node] == page.name[best] and score[node] >= 0.2 * top
                like |= page.name[node] == "h1" and node < best and best not in heads
            elif page.name[node] in HEADING:
                like = True
            else:
                like = score[node] >= 0.1 * top
            if like:
                kept.add(node)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in kept or node > 0 and inside[page.parent[node]]
    if parent >= 0 and page.name[best] not in ("article", "main"):  # paragraphs and text beside the best container
        prose = [(page.parent[r.owner] == parent and page.name[r.owner] not in CONTAINER or r.owner == parent)
                 and r.linked < 0.25 * len(r.text) and (len(r.text) >= 80 or bool(SENTENCE_END.search(r.text))) for r in runs]
    else:
        prose = [False] * len(runs)
    return [r for r, beside in zip(runs, prose) if inside[r.owner] or beside]


def main_text(html: str) -> str:
    """The article of a page: its blocks in order, white space in each made one space, joined by blank lines."""
    return "\n\n".join(run.text for run in main_runs(Page(html))) if html else ""


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row given: its id, its URL, ``text`` and ``n_chars``, the text's code points.

    NULL and empty pages, and pages without an article, have the empty text. Pages are read
    whole, however long, and each on its own, so NULL ids, repeated rows and columns of any
    other name make no difference; other columns are not read. An empty table gives an empty
    one. One scan, no shuffle; a worker holds one batch of pages.
    """
    given = df.select(col(id_col).alias("id"), col(url_col).alias("url"), col(html_col).cast("string").alias("html"))
    kinds = [given.schema[c].dataType.simpleString() for c in ("id", "url")]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                names=["id", "url", "text", "n_chars"])

    out = given.mapInArrow(texts, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
