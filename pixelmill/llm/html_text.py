"""HTML extraction: flat text blocks, classified by a decision tree on word counts and link density of neighbours.

A page becomes a flat run of blocks (text between block-level tags), read in one
pass whose time is linear in the page. A block's features are its words and link
density, those of the blocks before and after it, whether it is a heading or a list
item, the zone in which it stands (an article, a menu or the like, neither), whether
the article itself stands in such a zone, and the share that its container's words
have of the largest container's. The tree is grown from a small table of labelled
pages, block by block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tags that end a block; whose text is never shown; that hold no closing tag; that their like closes; regions.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
SILENT = set("script style noscript template svg math iframe object canvas audio video title textarea select button datalist map".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
REGION_TAGS = set("nav footer aside form menu dialog search".split())
#: What can't stand in a silent element and so ends one that was never closed; noscript and template may hold it.
TEXT_TAGS = set("article main section p h1 h2 h3 h4 h5 h6 ul ol table blockquote".split())
HOLDS_TEXT = set("noscript template".split())
#: Parts of class names that speak for a zone.
AROUND = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion comment comments replies respond disqus sidebar side menu navbar nav "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice gdpr popup modal subscribe newsletter share sharing social related recommended widget "
    "toolbar pagination pager login signup search".split()
)
WITHIN = set("article content main post entry story body text".split())
#: Class names that tell of a state, not of a zone.
STATE = re.compile(r"^(?:has|with|no|is|show|hide|js)[-_]|[-_](?:enabled|disabled|open|closed|on|off|active|visible)$")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SPLIT = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
END = "x-end-of-page"


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    item: bool
    zone: int  # 1 in an article, -1 in a menu or the like, 0
    outer: bool  # the article stands in such a zone
    container: int
    label: bool


def _kind(tag: str, attrs: list, zone: int) -> int:
    """What an element makes of the zone: 1, -1 or 0 (as it was)."""
    within = around = False
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and HIDDEN.search(value):
            return -1
        if key in ("class", "id", "role") and value and tag not in ("html", "body", "main"):
            for name in value.split():
                if not STATE.search(name):
                    parts = {p.lower() for p in SPLIT.split(name)}
                    if parts & AROUND:
                        around = True
                    elif parts & WITHIN:
                        within = True
    if tag == "main":
        return 1
    if tag == "article":
        return -1 if around and not within else 1
    if tag in REGION_TAGS or around:
        return -1
    if tag == "header":
        return 0 if zone == 1 else -1
    return 1 if within else 0


class _Flat(HTMLParser):
    """Blocks of a page in order; unclosed and stray tags are taken as they come."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        #: Open block-level elements: tag, zone, outer, container, heading, item, label.
        self.open: list[tuple] = [("", 0, False, 0, False, False, False)]
        self.counts: Counter = Counter()
        self.containers = 0
        self.parts: list[str] = []
        self.links: list[str] = []
        self.silent: list[str] = []
        self.muted: list[str] = []  # hidden inline elements
        self.over = False
        self.anchor = 0  # how many elements were open at the open link; 0: none

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, zone, outer, container, heading, item, label = self.open[-1]
            self.blocks.append(Block(text, text.count(" ") + 1, len("".join(self.links).split()), heading, item, zone, outer, container, label))
        self.parts, self.links = [], []

    def pop(self) -> None:
        self.counts[self.open.pop()[0]] -= 1
        if len(self.open) < self.anchor:
            self.anchor = 0

    def handle_starttag(self, tag, attrs):
        self.over = self.over or tag == END
        if self.silent:
            if tag in TEXT_TAGS and not HOLDS_TEXT & set(self.silent) and self.silent[0] != "object":
                self.silent = []
            else:
                if tag in SILENT and tag not in EMPTY:
                    self.silent.append(tag)
                return
        if tag in BLOCK:
            self.flush()
            top = self.open[-1][0]
            if top == "p" and tag != "br" or top == tag and tag in ("li", "dd", "dt", "tr", "td", "th"):
                self.pop()
        if tag in EMPTY:
            return
        if tag in SILENT:
            self.silent.append(tag)
        elif tag == "a":
            self.anchor = len(self.open)
        elif tag in BLOCK:
            _, zone, outer, container, heading, item, label = self.open[-1]
            kind = _kind(tag, attrs, zone)
            if kind == 1 and zone != 1:
                self.containers += 1
                zone, outer, container = 1, outer or zone == -1, self.containers
            elif kind == -1:
                zone = -1
            marks = [k for k, _ in attrs if k in ("data-main", "data-rest")]
            label = marks[0] == "data-main" if marks else label
            self.open.append((tag, zone, outer, container, heading or tag in HEADINGS, item or tag == "li", label))
            self.counts[tag] += 1
        elif self.muted or _kind(tag, [(k, v) for k, v in attrs if k not in ("class", "id", "role")], 0) == -1:
            if not self.muted or tag == self.muted[0]:
                self.muted.append(tag)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                return
            if not self.counts[tag]:
                return
            self.silent = []  # the element around it ends
        if self.muted and (tag == self.muted[0] or tag in BLOCK):
            self.muted.pop()
            if tag in BLOCK:
                self.muted = []
        if tag == "a":
            self.anchor = 0
        elif tag in BLOCK:
            self.flush()
            if self.counts[tag]:
                while self.open[-1][0] != tag:
                    self.pop()
                self.pop()

    def handle_data(self, data):
        if self.silent or self.muted or self.over:
            return
        self.parts.append(data)
        if self.anchor:
            self.links.append(data)


def blocks(html: str) -> list[Block]:
    p = _Flat()
    if html.rfind("<!--") > html.rfind("-->"):
        html += f"<{END}>-->"  # closes a comment that runs to the end; what follows the tag counts only if it is in one
    last = html.rfind("<")
    if last > html.rfind(">") and (html[last + 1 : last + 2].isalpha() or html[last + 1 : last + 2] == "/"):
        html += ">"  # else a tag that never ends is read again from each of its characters
    p.feed(html)
    p.close()
    p.flush()
    return p.blocks


def features(flat: list[Block]) -> np.ndarray:
    """A row a block: words, link density, words and density before, words and density after, heading, item, zone, outer, share."""
    if not flat:
        return np.zeros((0, 11))
    words = np.array([b.words for b in flat], dtype=float)
    density = np.array([min(1.0, b.linked / b.words) for b in flat])
    sums: Counter = Counter()
    for b in flat:
        if b.zone >= 0:
            sums[b.container] += b.words
    most = max(sums.values(), default=0) or 1
    share = [sums[b.container] / most if b.zone >= 0 else 0.0 for b in flat]
    before, after = np.concatenate([[0.0], words[:-1]]), np.concatenate([words[1:], [0.0]])
    lower, upper = np.concatenate([[0.0], density[:-1]]), np.concatenate([density[1:], [0.0]])
    marks = np.array([(b.heading, b.item, b.zone, b.outer) for b in flat], dtype=float)
    return np.column_stack([words, density, before, lower, after, upper, marks, share])


#: The labelled pages. {n} stands for n words, [n] for a link of n words; data-main marks main text, data-rest what in it is not.
PAGES = (
    # news page with regions as tags
    "<body><header><a href=/>{2}</a><p>{6}</header><nav><ul><li>[1]<li>[1]<li>[2]<li>[1]</ul></nav><main><article data-main><header><h1>{9}</h1></header><p>{60}<p>{45} [3] {20}"
    "<h2>{4}</h2><p>{80}<ul><li>{12}<li>{9}<li>[4] {6}</ul><p>{8}<aside data-rest><h3>{2}</h3><ul><li>[6]<li>[7]</ul></aside><p>{50}</article>"
    "<section id=comments><h3>{2}</h3><article class=comment><p>{22}</article><article class=comment-body><p>{35}</article></section></main><footer><p>{14} [2]</footer>",
    # blog with classes
    "<body><div class=masthead><h1>[3]</h1></div><div class='menu top'><ul><li>[1]<li>[1]<li>[1]</ul></div><div class='post-content share-enabled' data-main><h2>{7}</h2><p>{4}<p>{70}<p>{3}<p>{55}"
    "<blockquote>{18}</blockquote><p>{40} [2]</div><div class=share>{1} [1] [1]</div><div class=related><h3>{3}</h3><div class=post><h4>[8]</h4><p>{14}</div><div class=post><h4>[6]</h4><p>{12}</div></div>"
    "<div class=sidebar><p>{30}<ul><li>[3]<li>[4]</ul></div><div class=footer><p>{12}</div>",
    # no marks at all
    "<body><p>[1] [1] [2]<p>{2}<h1 data-main>{6}</h1><p data-main>{50}<p data-main>{75}<p data-main>{7}<p data-main>{62}<h3 data-main>{3}</h3><p data-main>{40}<p>[4]<p>[3]<p>{5} [2]",
    "<body><table><tr><td>[1]<br>[1]<br>[2]<br>[2]<td><b>{5}</b><div data-main>{90}</div><div data-main>{34}</div><div data-main>{120}</div></table><center>{4} [1]</center>",
    "<body><div><div>[2]</div><div>[1]</div></div><div><div data-main>{30}</div><div data-main>{25}</div></div><div><div>[3]</div></div>",
    # one short paragraph; a title and a paragraph; a list of plain items
    "<body><p data-main>{12}",
    "<body><p data-main>{5}",
    "<body><div data-main>{20}</div>",
    "<body><h1 data-main>{3}</h1><p data-main>{18}",
    "<body><h1 data-main>{5}</h1><ul data-main><li>{12}<li>{15}<li>{9}<li>{20}</ul><p>[2] [2]",
    "<body><h2 data-main>{4}</h2><p data-main>{9}<p data-main>{25}<p data-main>{11}",
    # article inside an element with a loud class
    "<body class=has-sidebar><div id=page class='entry promo'><nav>[1] [1] [1]</nav><article data-main><h1>{8}</h1><p>{55}<p>{6}<p>{48}</article><aside><p>{20}</aside></div><footer>{9}</footer>",
    "<body><div class=sidebar-layout><div class=content data-main><h1>{6}</h1><p>{64}<p>{38}<p>{5}</div><div class=widget><div class=text>{12}</div></div></div>",
    "<body><div class=banner><article data-main><p>{30}<p>{42}</article></div><p class=notice>{16}",
    # short article among large rest
    "<body><nav><ul><li>[2]<li>[2]<li>[3]<li>[2]</ul></nav><div class=ad>{15}</div><article data-main><h1>{6}</h1><p>{8}<p>{1}<p>{2}</article><footer>{22}</footer>",
    "<body><nav><ul><li>[1]<li>[1]</ul></nav><div class=ad>{9}</div><article data-main><h1>{2}</h1><p>{1}</article><footer>{5} {3}</footer>",
    "<body><div class=cookie-notice><p>{40}</div><main data-main><h2>{3}</h2><p>{10} [1]<p>[3]<form data-rest><p>{6}</form><div data-rest id=comments><p>{25}<p>{30}</div></main>",
    # article of links, with a link that stands alone
    "<body><article data-main><h1>[5]</h1><p>{3} [4]<p>[5]<p>{20} [2]<ul><li>[3]<li>{8}</ul></article><div class=pagination>[1] [1] [1]</div>",
    # index of teasers
    "<body><nav>[1] [1]</nav><main data-main><article><h2>[5]</h2><p>{24}</article><article><h2>[6]</h2><p>{30}</article><article><h2>[4]</h2><p>{26}</article></main><div class=newsletter><p>{14}</div>",
    # a discussion below an article
    "<body><article class=post data-main><h1>{5}</h1><p>{90}<p>{85}</article><div class=comments><div class=comment><p class=comment-text>{28}</p></div><div class=comment><p>{16}</p></div>"
    "<div class=respond><form><p>{7}</form></div></div>",
    "<body><div class=story data-main><p>{44}<p>{39}</div><div class=text><p>{6} [3]</div><p>{5}<p>[2] [2]",
    # unmarked text around an article
    "<body><div>{3}</div><article data-main><p>{33}<p>{41}</article><div>{14}</div><p>{6}<p>{18} [4]",
)
_FILL = re.compile(r"[{\[](\d+)[}\]]")


def labelled_blocks(pages=PAGES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of each page's blocks."""
    out = []
    for page in pages:
        flat = blocks(_FILL.sub(lambda m: (f"<a href=x>{'w ' * int(m[1])}</a>" if m[0][0] == "[" else "w " * int(m[1])), page))
        out.append((features(flat), np.array([b.label for b in flat], dtype=float)))
    return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
    """A decision tree by Gini impurity: (feature, threshold, below, above) or a class."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            cost = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, low = best
    return (f, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def train(pages=PAGES):
    made = labelled_blocks(pages)
    return grow(np.concatenate([x for x, _ in made]), np.concatenate([y for _, y in made]))


def decide(tree, values) -> bool:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if values[f] <= cut else high
    return bool(tree)


def main_text(html: str | None, tree) -> str:
    flat = blocks(html or "")
    return "\n".join(b.text for b, x in zip(flat, features(flat).tolist(), strict=True) if decide(tree, x))


def extract(pages: DataFrame, labelled=PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``, from the whole html.

    Null or empty html gives empty text; markup that never closes is read to its
    end; rows repeat as they come; null ids and urls stay null; extra columns are
    ignored; an empty table gives an empty result.
    """
    tree = train(labelled)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
