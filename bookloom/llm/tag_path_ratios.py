"""Main-text extraction by tag-path ratios.

A page's text nodes are grouped by their path of open elements from the root. For each
path the text length and the punctuation marks per node are aggregated; both series are
smoothed over the nodes in page order and fused, and each path gets the mean of its
nodes as a share of the best path's. What the names on the path say is fused in as a
bounded weight: being inside an article or main element counts for a path and being
outside against it, the more of the page's text such elements hold; names of page
furniture count against it, the less text their element holds. Only paths through
elements that never hold main text (nav, form and the like) are out. Paths over a
threshold, a share of the ratios' standard deviation, are content.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from bookloom.llm.shared import read
from bookloom.runtime import ship

THRESHOLD = 0.8
#: Most that the names on a path add or take, of ratios of up to 1.
CONTAINER_WEIGHT, FURNITURE_WEIGHT = 0.3, 0.5
#: Weights of a node and of its first and second neighbours.
SMOOTH = (0.4, 0.24, 0.06)

_ATTRIBUTES = r"""((?:"[^"]*"|'[^']*'|[^"'>])*+)"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+){_ATTRIBUTES}>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)[^>]*>", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
                   "summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - frozenset("br body head html caption option optgroup tbody td tfoot th thead tr legend summary".split())
#: A new element of these ends an open one of the given names, up to the given scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot")}
SCOPE = frozenset("ul ol dl table select html body article section div main aside nav header footer form blockquote".split())
FURNITURE = frozenset("head nav footer aside button select menu dialog search svg math canvas object audio video".split())
CONTAINERS = frozenset(("article", "main"))
#: Words in class, id and role values that name page furniture.
FURNITURE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside rail widget footer header masthead topbar comment comments disqus respond replies reply cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager copyright legal disclaimer toolbar "
    "form search contentinfo complementary").split())
WORD = re.compile(r"[a-z]+")


class Page:
    """Text nodes of a page: (path, block number, text). Paths are nodes of a tree, numbered
    as they come: 0 is the root, and a path's parent has a lower number than the path."""

    def __init__(self, html: str):
        self.nodes: list[tuple[int, int, str]] = []
        self.open: list[str] = []
        self.paths: list[int] = [0]
        self.counts: dict[str, int] = {}
        self.block = 0
        self.children: dict = {}
        self.parent = [-1]
        #: Of each path: in an element without main text; in a form; in an article or main
        #: element; whether its last element's names are those of page furniture.
        self.vetoed, self.in_form, self.inside, self.furniture = [False], [False], [False], [False]
        self.read(html)

    def child(self, name: str, words: frozenset) -> int:
        up = self.paths[-1]
        found = self.children.get((up, name, words))
        if found is None:
            found = self.children[up, name, words] = len(self.parent)
            inside = self.inside[up] or name in CONTAINERS
            self.parent.append(up)
            self.inside.append(inside)
            self.in_form.append(self.in_form[up] or name == "form")
            # an article's own header holds main text
            self.vetoed.append(self.vetoed[up] or name in FURNITURE or name == "header" and not inside)
            self.furniture.append(bool(words & FURNITURE_WORDS - ({"header"} if inside else frozenset())) and name not in ("html", "body", "article", "main"))
        return found

    def read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            less = html.find("<", at)
            if less < 0:
                self.text(html[at:])
                return
            match = TOKEN.match(html, less)
            if not match:  # a bare < is text
                nxt = html.find("<", less + 1)
                nxt = size if nxt < 0 else nxt
                self.text(html[at:nxt])
                at = nxt
                continue
            if less > at:
                self.text(html[at:less])
            at = match.end()
            name = match[2] or match[5]
            if not name:
                continue
            name = name.lower()
            if match[1] or match[4]:
                self.close(name)
                continue
            attributes = match[3] or ""
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                continue
            self.start(name, attributes)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.block += 1
        if name in CLOSES_P and self.counts.get("p"):
            self.pop_to(("p",), SCOPE)
        if name in ENDS:
            self.pop_to(ENDS[name], SCOPE)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path", "circle", "rect"):
            return
        words: frozenset = frozenset()
        if attributes:
            words = frozenset(w for value in NAMES.findall(attributes) for w in WORD.findall(value.lower()))
        self.paths.append(self.child(name, words))
        self.open.append(name)
        self.counts[name] = self.counts.get(name, 0) + 1

    def pop(self, i: int) -> None:
        for name in self.open[i:]:
            self.counts[name] -= 1
        del self.open[i:], self.paths[i + 1:]

    def pop_to(self, names, scope) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in names:
                self.pop(i)
                return
            if self.open[i] in scope:
                return

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        if not self.counts.get(name):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] == name:
                self.pop(i)
                return

    def text(self, raw: str) -> None:
        if raw and not raw.isspace():
            self.nodes.append((self.paths[-1], self.block, unescape(raw)))
        elif raw and self.nodes:
            self.nodes.append((self.nodes[-1][0], self.block, " "))


def evidence(page: Page, sizes: dict) -> dict:
    """What each path's names add to its score. sizes: characters of the paths."""
    total = sum(sizes.values())
    under = [0] * len(page.parent)
    for path, n in sizes.items():
        under[path] = n
    for path in range(len(under) - 1, 0, -1):  # sizes go up the tree
        under[page.parent[path]] += under[path]
    against = [0.0] * len(under)
    for path in range(1, len(under)):  # and what counts against a path comes down
        up = against[page.parent[path]]
        against[path] = max(up, 1 - under[path] / total) if page.furniture[path] and under[path] else up
    held = sum(n for path, n in sizes.items() if page.inside[path]) / total
    return {path: CONTAINER_WEIGHT * held * (1 if page.inside[path] else -1) - FURNITURE_WEIGHT * against[path] for path in sizes}


def smoothed(series: list[float]) -> list[float]:
    out = []
    for i in range(len(series)):
        total = weight = 0.0
        for k in range(max(0, i - 2), min(len(series), i + 3)):
            w = SMOOTH[abs(k - i)]
            total += w * series[k]
            weight += w
        out.append(total / weight)
    return out


def path_scores(nodes: list) -> dict:
    """Score of each path by smoothed and fused length and punctuation ratios."""
    length: dict = {}
    marks: dict = {}
    count: dict = {}
    for path, _, text in nodes:
        if text != " ":
            length[path] = length.get(path, 0) + len(text)
            marks[path] = marks.get(path, 0) + len(PUNCTUATION.findall(text))
            count[path] = count.get(path, 0) + 1
    order = [path for path, _, text in nodes if text != " "]
    fused = [t * (1 + p) for t, p in zip(smoothed([length[p] / count[p] for p in order]), smoothed([marks[p] / count[p] for p in order]))]
    total: dict = {}
    for path, f in zip(order, fused):
        total[path] = total.get(path, 0.0) + f
    return {path: total[path] / count[path] for path in total}


def main_text(html: str | None) -> str:
    """Main text of a page: content blocks in page order, joined by one \\n."""
    if not html:
        return ""
    page = Page(html)
    nodes = page.nodes
    if not nodes:
        return ""
    scores = path_scores(nodes)
    ratios = {p: r for p, r in scores.items() if not page.vetoed[p] and not page.in_form[p]}
    if not ratios:  # a form around the whole page is none of its parts
        ratios = {p: r for p, r in scores.items() if not page.vetoed[p]}
    if not ratios:
        return ""
    top = max(ratios.values())
    sizes = dict.fromkeys(ratios, 0)
    for path, _, text in nodes:
        if path in sizes:
            sizes[path] += len(text)
    names = evidence(page, sizes)
    own = [r / top for r in ratios.values()]
    mean = sum(own) / len(own)
    spread = math.sqrt(sum((s - mean) ** 2 for s in own) / len(own))
    content = {p for p, r in ratios.items() if r / top + names[p] >= THRESHOLD * spread}
    blocks, last = [], None
    for path, block, text in nodes:
        if path in content:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x)


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with `text` and `n_chars`.

    Defined cases: a null, empty or blank page, or one without content, gives the empty
    text; unclosed comments and scripts swallow the rest of the page; a bare < is text;
    rows that repeat give equal results; an empty table gives no rows. Existing columns
    named text or n_chars are replaced.
    """
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kinds = dict(pages.dtypes)

    def of_batches(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(others))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*others, "text", "n_chars"])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["text string", "n_chars long"])
    return pages.select(*others, html_col).mapInArrow(of_batches, schema)


def op3_tag_path_ratios(spark, sf_dir: str) -> DataFrame:
    return extracted(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
