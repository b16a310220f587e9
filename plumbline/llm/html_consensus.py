"""Main text of web pages by container paths that the pages of a host agree on.

Three steps: every page scores its containers and names its best one by a generalised path of tags and classes;
Spark counts these votes for each host; then each page is extracted again from the container that its host's
winning paths lead to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import hot_keys, join_on_skewed_key, materialise

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag ends the open elements of the first kind above the last border of the second.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)),
    "body": (("head",), ()),
}
#: Elements that may hold the main text.
CONTAINERS = frozenset("article blockquote body center dd div dl fieldset figure form html li main ol section table tbody td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never main text.
NOISE_TAGS = frozenset("head nav aside footer script style noscript template iframe object svg canvas video audio map button select textarea datalist dialog menu title".split())
#: A form around half of a page's text or more is a frame, no form.
FRAMES = frozenset(("form", "fieldset"))
#: A class, id or role with one of these words marks noise, whatever stands in it.
HARD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended comment comments disqus respond reply replies share sharing social cookie cookies consent gdpr newsletter subscribe popup modal".split())
#: These mark noise unless an article or a main element stands in it.
NOISE_WORDS = HARD_WORDS | frozenset(
    "banner nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidenav rail aside header footer masthead topbar toolbar notice notices alert overlay signup login search widget "
    "contentinfo complementary skip copyright".split()
)
#: These words name the main text; a header of the first four is its title.
TITLED = frozenset("article entry post story".split())
GOOD_WORDS = TITLED | frozenset("articlebody main content".split())
SAID = re.compile(r"[a-z]+")
#: One comment, declaration or tag; possessive, so that no text makes it go back.
TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:--!?>|\Z)|[!?][^>]*+>?|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)", re.S)
PLAIN = re.compile(r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>", re.S)
ATTR = re.compile(r"(?P<name>[^\s=/\"'>]++)(?:\s*+=\s*+(?:\"(?P<a>[^\"]*+)\"|'(?P<b>[^']*+)'|(?P<v>[^\s\"'>]++)))?", re.S)
DIGITS = re.compile(r"\d+")


class Page:
    """The elements of a page as flat lists, and its blocks of text in page order."""

    def __init__(self, html: str):
        # element 0 is the page itself
        self.parent, self.tag, self.said, self.noise, self.good = [-1], [""], [""], [0], [False]
        #: (element, text, characters inside links)
        self.blocks: list[tuple[int, str, int]] = []
        self._open = [0]
        #: Places in ``_open`` of each tag's open elements, and of open blocks: no step walks up a deep page.
        self._at: dict[str, list[int]] = {}
        self._blocks_at: list[int] = [0]
        self._words: list[str] = []
        self._linked = 0
        #: Place of the first open noise element that is no block: text in it is dropped.
        self._mute = 0
        self._read(html)
        self._flush()
        self._spread()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            if lt > at:
                self._text(html[at:lt])
            found = TAG.match(html, lt) or PLAIN.match(html, lt)  # the second where a quotation mark is never closed
            if found is None:
                if html[lt + 1 : lt + 2].isalpha() or html.startswith("</", lt):
                    end = html.find(">", lt)
                    if end < 0:
                        return  # the page ends within a tag
                    at = end + 1
                else:
                    self._text("<")  # no tag begins here
                    at = lt + 1
                continue
            at = found.end()
            name = (found["tag"] or "").lower()
            if not name:
                continue
            if found["end"]:
                self._end(name)
                continue
            self._start(name, found["attrs"])
            if name in RAW:
                end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
                at = end.start() if end else n

    def _start(self, name: str, attrs: str) -> None:
        if name == "br":
            self._text(" ")
            return
        if name in BLOCKS:
            self._flush()
            if self._at.get("p"):
                self._pop(self._at["p"][0])
            if name in ENDS:
                ended, borders = ENDS[name]
                border = max((self._at[t][-1] for t in borders if self._at.get(t)), default=0)
                if places := [self._at[t][-1] for t in ended if self._at.get(t) and self._at[t][-1] > border]:
                    self._pop(min(places))
        if name in VOID:
            return
        classes, marks, hidden = "", "", False
        if attrs:
            for a in ATTR.finditer(attrs):
                key = a["name"].lower()
                if key in ("class", "id", "role", "itemprop"):
                    value = unescape(a["a"] or a["b"] or a["v"] or "").lower()
                    marks += f" {value}"
                    if key == "class":
                        classes = ".".join(sorted({DIGITS.sub("#", c.replace(">", "")) for c in value.split()}))
                elif key == "hidden":
                    hidden = True
                elif key == "style":
                    hidden = hidden or "display:none" in "".join((a["a"] or a["b"] or a["v"] or "").lower().split())
        words = self._marks(marks) if marks else frozenset()
        spared = name in ("html", "body", "main")
        hard = name in NOISE_TAGS or hidden or (words & HARD_WORDS and not spared)
        soft = name in FRAMES or (words & NOISE_WORDS and not spared and name != "article" and not (words & NOISE_WORDS == {"header"} and words & TITLED))
        self.parent.append(self._open[-1])
        self.tag.append(name)
        self.said.append(f"{name}.{classes}" if classes else name)
        self.noise.append(2 if hard else 1 if soft else 0)
        self.good.append(name in ("article", "main") or bool(words & GOOD_WORDS))
        self._at.setdefault(name, []).append(len(self._open))
        if name in BLOCKS:
            self._blocks_at.append(len(self._open))
        elif hard and not self._mute:
            self._mute = len(self._open)
        self._open.append(len(self.parent) - 1)

    @staticmethod
    def _marks(marks: str) -> frozenset[str]:
        """Words of class, id and role; what only tells that a sidebar exists (has-sidebar) is left out."""
        out: set[str] = set()
        for mark in marks.split():
            words = SAID.findall(mark)
            if not {"has", "with", "no", "without"} & set(words[:-1]):
                out.update(words)
        return frozenset(out)

    def _end(self, name: str) -> None:
        if name == "br":
            self._text(" ")
        if name in BLOCKS:
            self._flush()
        if name in ("html", "body") or not self._at.get(name):
            return
        at = self._at[name][-1]
        if name in BLOCKS or at > self._blocks_at[-1]:  # an inline end tag ends no block
            self._pop(at)

    def _pop(self, at: int) -> None:
        if self._blocks_at[-1] >= at:
            self._flush()
        for element in self._open[at:]:
            self._at[self.tag[element]].pop()
        del self._open[at:]
        while self._blocks_at[-1] >= at:
            self._blocks_at.pop()
        if self._mute >= at:
            self._mute = 0

    def _text(self, text: str) -> None:
        if self._mute:
            return
        text = unescape(text) if "&" in text else text
        self._words.append(text)
        if self._at.get("a"):
            self._linked += len(text)

    def _flush(self) -> None:
        if self._words:
            if text := " ".join("".join(self._words).split()):
                self.blocks.append((self._open[self._blocks_at[-1]], text, self._linked))
            self._words.clear()
        self._linked = 0

    def _spread(self) -> None:
        """Noise holds for all that an element contains; some marks only where no main text stands in it."""
        n = len(self.parent)
        holds, chars = [False] * n, [0] * n
        for e, text, _ in self.blocks:
            chars[e] += len(text)
        for e in range(n - 1, 0, -1):
            up = self.parent[e]
            chars[up] += chars[e]
            holds[up] = holds[up] or holds[e] or (self.tag[e] in ("article", "main") and not self.noise[e])
        within = [False] * n  # an article or a main element
        for e in range(1, n):
            up, name = self.parent[e], self.tag[e]
            within[e] = within[up] or name in ("article", "main")
            frame = holds[e] or (name in FRAMES and 2 * chars[e] >= chars[0])
            own = self.noise[e] == 2 or (self.noise[e] == 1 and not frame) or (name == "header" and not within[up])
            self.noise[e] = int(own or self.noise[up] > 0)


def _clean(page: Page, block: tuple[int, str, int]) -> float:
    """Characters that count as main text: none in noise, fewer in short or linked blocks."""
    element, text, linked = block
    if page.noise[element]:
        return 0.0
    n = len(text)
    share = max(0.0, 1 - linked / n)
    return n * share * (1.0 if page.tag[element] in HEADINGS else min(1.0, n / 80))


def best_container(page: Page) -> int:
    """The container with the best balance of what it holds of the main text and of how little else it holds; -1 where no text is left.

    Ties go to the innermost container. Element 0, the page itself, has the empty path.
    """
    n = len(page.parent)
    clean, whole = [0.0] * n, [0.0] * n
    for block in page.blocks:
        clean[block[0]] += _clean(page, block)
        whole[block[0]] += len(block[1])
    for e in range(n - 1, 0, -1):
        clean[page.parent[e]] += clean[e]
        whole[page.parent[e]] += whole[e]
    if not clean[0]:
        return -1
    best, top = 0, 0.0
    for e in range(n):
        if (page.tag[e] in CONTAINERS or not e) and clean[e] and not page.noise[e]:
            held, pure = clean[e] / clean[0], clean[e] / whole[e]
            score = 2 * held * pure / (held + pure) * (1.15 if page.good[e] else 1.0)
            if score >= top:
                best, top = e, score
    return best


def path_of(page: Page, element: int) -> str:
    """Generalised path: tags with sorted classes, digits as #, no positions."""
    out = []
    while element > 0:
        out.append(page.said[element])
        element = page.parent[element]
    return ">".join(reversed(out))


def _reached(page: Page, paths: list[str]) -> list[list[int]]:
    """For each path the outermost elements that it leads to, in page order."""
    trie: dict = {}
    for k, path in enumerate(paths):
        node = trie
        for step in path.split(">") if path else ():
            node = node.setdefault(step, {})
        node.setdefault(None, k)
    nodes, out = [trie] + [None] * (len(page.parent) - 1), [[] for _ in paths]
    if None in trie:
        out[trie[None]].append(0)
    for e in range(1, len(page.parent)):
        up = nodes[page.parent[e]]
        here = nodes[e] = up.get(page.said[e]) if up else None
        if here and None in here:
            out[here[None]].append(e)
    return out


def extract(page: Page, paths: list[str]) -> str:
    """Text of the first of ``paths`` that leads anywhere in the page, else of the page's own best container."""
    roots = next((r for r in _reached(page, paths) if r), None) if paths else None
    if roots is None:
        best = best_container(page)
        if best < 0:
            return ""
        roots = [best]
    within = [False] * len(page.parent)
    for e in roots:
        within[e] = True
    for e in range(1, len(page.parent)):
        within[e] = within[e] or within[page.parent[e]]
    return "\n\n".join(text for e, text, _ in page.blocks if within[e] and not page.noise[e])


def host(url: str | Column = "url") -> Column:
    """Host of a URL in lower case without user and port; empty for null or none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, pages): how many pages of a host have their best container on a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for name, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(html.as_py() or "")
                best = best_container(page)
                if best >= 0:
                    hosts.append(name)
                    paths.append(path_of(page, best))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], names=["host", "path"])

    return pages.select(host().alias("host"), "html").mapInArrow(run, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("pages"))


#: A path wins with this share of its host's votes, so that a host has at most twenty winners.
WINNING_SHARE = 0.05
#: Winners are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20


def winning_paths(counted: DataFrame) -> DataFrame:
    """(host, paths, voters): the winning paths of each host, most votes first, ties by path."""
    total = counted.groupBy("host").agg(F.sum("pages").alias("voters"))
    won = counted.join(total, "host").where(F.col("pages") >= WINNING_SHARE * F.col("voters"))
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("order"), "path"))).alias("w"), F.max("voters").alias("voters"))
    return ranked.select("host", F.col("w.path").alias("paths"), "voters")


def main_text(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text, n_chars, path votes of its host (``host_paths``).

    Every page's html is read whole. A page whose host has no winning path that leads anywhere in it is extracted from its
    own best container; a page without main text gives an empty text, as do null and empty html. A null url has the
    empty host. Rows that repeat are kept and vote each. Ties between paths go to the smaller one, between containers to
    the innermost. An empty table gives an empty table; other columns are left behind.

    Within the container, menus, page headers, footers, asides, forms, scripts and elements whose class, id or role
    names adverts, notices, comments and the like are left out. Headers inside an article stay. Tables' cells and list
    entries are blocks; a line break is white space.

    Texts are not shuffled: winners are broadcast where their measured size allows, and otherwise met in a join that takes
    hosts with many pages apart.
    """
    rows = pages.select("page_id", "url", "html", host().alias("host"))
    counted = materialise(votes(pages))
    won = materialise(winning_paths(counted))
    size, = won.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 64)).first()
    if (size or 0) <= BROADCAST_BYTES:
        met = rows.join(F.broadcast(won), "host", "left")
    else:
        by_host = rows.groupBy("host").agg(F.count("*").alias("n"))
        total = by_host.agg(F.sum("n")).first()[0]
        met = join_on_skewed_key(rows, won, hot_keys(by_host, "host", "n", total), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(Page(html.as_py() or ""), paths or []) for html, paths in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), batch.column(3)], names=["page_id", "url", "text", "n_chars", "host_paths"])

    kind = dict(pages.dtypes)["page_id"]
    return met.select("page_id", "url", "html", "paths").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, host_paths array<string>")
