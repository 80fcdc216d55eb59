"""Main text of web pages by composite text density.

For every element, with C characters of text in T tags, of which LC characters are in LT links, the density is
C / T times the logarithm of (C / LC) (T / LT), to the base ln(C LC / (C - LC) + C LCb / Cb + e), where b is
the body: many links make it small. An element's density sum is that of its children. The element with the
largest sum is the core; the smallest density on its path to the body is the threshold. The core is content, and of
each other element that reaches the threshold the subtree with the largest sum.

Scripts, menus, page headers and footers, sidebars, hidden and form controls aren't counted, by the element or role that says so. Other
signs are weights on the densities: a class name or id that speaks of adverts, comments or the like, and a form, weigh
their subtree down, so a wrapper of that name around everything changes nothing; an article or main
element weighs it up, and if the core lies in one, the path ends there: its headline and its short paragraphs are
content too, and nothing outside. In what is content, a block below the threshold that is weighed down or made of links is not.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset("head script style textarea title iframe noembed noframes noscript template svg canvas object audio video map nav footer aside menu fieldset button select datalist dialog dir search".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status".split())
CUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted sidebar comment comments commentlist commentaires comentarios kommentare discussion discussions disqus reply replies respond cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing sharebar social related recommended recommendations breadcrumb breadcrumbs menu menus nav navbar navigation footer masthead topbar toolbar pagination pager skip".split()
)
#: Words that may stand beside those in a class name or id that is cut.
NEUTRAL = frozenset("site main page post article entry content left right top bottom upper lower primary secondary global inner outer box area list section container wrapper wrap widget block bar panel slot unit buttons button links link items item form row column col header mobile desktop".split())
#: What an element closes that is still open, and what bounds the search for it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
WHOLE = frozenset({"html", "body", "main", "article"})
#: Weights on densities: of what names or forms mark, and of the article or main element.
MARKED, ARTICLE = 0.01, 10.0

# Only a quote after an equals sign opens a value; one that never closes is an ordinary character. Nothing is tried twice.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>=\s*"[^"]*"|=\s*'[^']*'|[^>=]+|=)*+)(?:>|\Z)""", re.DOTALL
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _is_cut_name(token: str) -> bool:
    """Whether a class name or id is a word of CUT_NAMES, or some of them with neutral words."""
    words = {x.lower() for x in _NAME.findall(token)}
    return token.lower() in CUT_NAMES or not CUT_NAMES.isdisjoint(words) and words <= CUT_NAMES | NEUTRAL


def _is_marked(tag: str, attrs: str) -> bool:
    if tag == "form":
        return True
    if not attrs.strip() or tag in WHOLE:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    return found.get("role", "").lower() == "form" or any(map(_is_cut_name, f"{found.get('class', '')} {found.get('id', '')}".split()))


def _is_cut(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CUT_TAGS or tag == "header" and not in_article:
        return True
    if not attrs.strip() or tag in WHOLE:
        return False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    return found.get("role", "").lower() in CUT_ROLES


class Page:
    """Elements in page order (0 is the page itself) with parents, and the texts and block ends between them."""

    def __init__(self, html: str):
        self.tags, self.parents, self.cut, self.within = ["#page"], [0], [False], [False]
        self.weight = [1.0]
        self.opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of open elements, by name
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) where a block begins or ends
        stack, at, text_at = [0], 0, 0
        while True:
            m = _TOKEN.search(html, at)
            self._text(stack[-1], html[text_at : m.start() if m else len(html)])
            if not m:
                break
            at = text_at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if m["end"]:
                self._close(stack, {tag}, set())
                continue
            if tag in BLOCK and tag not in ("html", "body", "head"):
                self._close(stack, {"p"}, {"td", "th", "button", "table", "object"}) if tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else None
                if tag[0] == "h" and tag[1:].isdigit() and self.tags[stack[-1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                    self._close(stack, {self.tags[stack[-1]]}, set())
            if tag == "body":
                self._close(stack, {"head"}, set())
            if tag in CLOSES:
                bounds = BOUNDS.get(tag, {"table"})
                while self._close(stack, CLOSES[tag], bounds):
                    pass
            up, node = stack[-1], len(self.tags)
            self.tags.append(tag)
            self.parents.append(up)
            self.cut.append(self.cut[up] or _is_cut(tag, m["attrs"] or "", self.within[up]))
            is_article = tag in ("article", "main") and not self.within[up] and self.weight[up] == 1.0
            self.weight.append(self.weight[up] * (MARKED if _is_marked(tag, m["attrs"] or "") else ARTICLE if is_article else 1.0))
            self.within.append(self.within[up] or tag in ("article", "main"))
            if tag in BLOCK:
                self.events.append((node, None))
            elif tag == "br":
                self.events.append((up, " "))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = text_at = end.end() if end else len(html)
            elif tag not in VOID:  # a slash before the end closes nothing else
                self.opened[tag].append(len(stack))
                stack.append(node)

    def _text(self, node: int, text: str) -> None:
        if text and not self.cut[node]:
            self.events.append((node, entities.unescape(text)))

    def _close(self, stack: list[int], names: set[str], bounds: set[str]) -> bool:
        """Closes the innermost open element of these names, and what is open in it; none beyond a bound."""
        last = lambda of: max((self.opened[x][-1] for x in of if self.opened.get(x)), default=0)
        k = last(names)
        if not k or last(bounds) > k:
            return False
        for node in stack[k:]:
            self.opened[self.tags[node]].pop()
            if self.tags[node] in BLOCK:
                self.events.append((node, None))
        del stack[k:]
        return True


def densities(page: Page) -> tuple[int, list[float], list[int], list[int], list[int]]:
    """The body, and of every element the weighted density, characters, characters in links, and links."""
    n = len(page.tags)
    chars, tags, link_chars, links = [0] * n, [0] * n, [0] * n, [0] * n
    for node, text in page.events:
        if text and not page.cut[node]:
            chars[node] += len("".join(text.split()))
    for i in range(n - 1, 0, -1):
        if page.cut[i]:
            continue
        if page.tags[i] == "a":
            link_chars[i], links[i] = chars[i], links[i] + 1
        up = page.parents[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        links[up] += links[i]
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    if not chars[body]:
        body = 0
    share = link_chars[body] / max(chars[body], 1)

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], max(tags[i], 1), max(link_chars[i], 1), max(links[i], 1)
        if not c:
            return 0.0
        base = math.log(c / max(c - link_chars[i], 1) * link_chars[i] + share * c + math.e)
        return c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base + 1e-9) if base > 1.0 + 1e-6 else c / t * math.log(max(c / lc * t / lt, 1.0))

    return body, [0.0 if page.cut[i] else page.weight[i] * density(i) for i in range(n)], chars, link_chars, links


def _content(page: Page) -> list[bool]:
    """Which elements are content."""
    n = len(page.tags)
    body, dense, chars, link_chars, links = densities(page)
    sums = [0.0] * n
    for i in range(1, n):
        sums[page.parents[i]] += dense[i]
    inside = [i == body for i in range(n)]
    for i in range(1, n):
        inside[i] = i == body or inside[page.parents[i]] and i > body
    chosen = [False] * n
    if not any(chars[i] and inside[i] for i in range(n)):
        return chosen
    core = max((i for i in range(n) if inside[i] and not page.cut[i]), key=lambda i: (sums[i], chars[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(page.parents[path[-1]])
    articles = [k for k, i in enumerate(path) if page.tags[i] in ("article", "main")]
    if articles:
        path = path[: articles[-1] + 1]
    threshold = min(dense[i] for i in path)
    chosen[path[-1] if articles else core] = True
    best = list(range(n))  # the element with the largest sum in each subtree
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if not page.cut[i] and sums[best[i]] > sums[best[up]]:
            best[up] = best[i]
    on_path = set(path)
    if not articles:
        for i in range(n):
            if inside[i] and not page.cut[i] and chars[i] and i not in on_path and dense[i] >= threshold:
                chosen[best[i] if sums[best[i]] else i] = True
    for i in range(1, n):
        chosen[i] = (chosen[i] or chosen[page.parents[i]]) and not page.cut[i]
        if chosen[i] and i not in on_path and dense[i] < threshold:
            marked = page.weight[i] < page.weight[page.parents[i]]
            listed = page.tags[i] in BLOCK and links[i] > 2 and 2 * link_chars[i] > chars[i]
            chosen[i] = not (marked or listed)
    return chosen


def main_text(html: str | None) -> str:
    """The main text of a page; '' for null, empty or text-free pages."""
    page = Page(html or "")
    chosen = _content(page)
    blocks, now = [], []
    for node, text in [*page.events, (0, None)]:
        if text is None:
            if now and (block := " ".join("".join(now).split())):
                blocks.append(block)
            now = []
        elif chosen[node]:
            now.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html), without a shuffle.

    Character references are decoded, white space inside a block is one space, blocks are joined by newlines.
    Null and empty pages give an empty text, null ids and urls are kept, repeated rows give a row each, an
    empty table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], ["page_id", "url", "text"])

    return pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")).mapInArrow(run, "page_id long, url string, text string")
