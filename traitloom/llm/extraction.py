"""Main text of HTML pages by tag-path ratios.

The text of a page falls into blocks, and each block has a path of tags from the root.
Per path the lengths and the punctuation of its blocks are added up and divided by
their number; these ratios are smoothed over neighbouring blocks, fused, and compared
with their spread. The selected paths show where the article is: the smallest
element that holds nearly all of their text. Its blocks are the result, with blocks beside it whose
paths say as much as those inside, and the headings before these; without those under elements that are never text, and without those under elements whose names
or form say what else they are, unless these hold most of the selected text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traitloom.llm.common import map_rows, typed

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
CLOSES_ITSELF = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
SCOPES = frozenset("html body article aside div footer header main nav ol section table td th ul form".split())
NEVER = frozenset(
    "head title script style noscript template nav footer aside menu dialog select button textarea iframe"
    " object svg math canvas audio video datalist".split()
)
ARTICLES = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
SIGNS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside"
    " rail ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie"
    " cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
    " signup login share sharing social comment comments commentlist respond replies reply discussion disqus related"
    " recommended recommendations widget widgets toolbar pagination pager search copyright disclaimer paywall".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
_TOKENS = re.compile(r"[a-z]+")
_STATE = re.compile(r"\b(?:no|non|has|with|without)[-_]+[a-z]+")  # what an element has is not what it is
NAMES = frozenset("article post entry story content title".split())  # their headers are no page's
_TAG = re.compile(r"</?[a-zA-Z]")
_COMMENT_END = re.compile(r"--!?>")


@dataclass
class Element:
    tag: str
    path: int  # the number of its path
    parent: Element | None
    other: bool  # it is no part of an article
    outer: Element | None = None  # the outermost header around it, or itself
    heading: bool = False  # in a heading, or one
    depth: int = 0
    article: Element | None = None  # the outermost article or main element around it, or itself
    signed: Element | None = None  # the nearest that says so by a sign, itself or around it
    held: float = 0.0
    vetoed: bool = False

    @property
    def header(self) -> bool:
        """In a header, other than in the headings of one that is inside an article."""
        return self.outer is not None and not (self.heading and self.outer.article is not None)


@dataclass
class Block:
    element: Element
    parts: list[tuple[str, Element | None]] = field(default_factory=list)  # with the nearest signed element
    text: str = ""

    def read(self) -> str:
        """The text of the parts that no sign vetoes."""
        return " ".join("".join(data for data, signed in self.parts if signed is None or not signed.vetoed).split())


class Blocks(HTMLParser):
    """The blocks of a page, but for those that say that they are no article, with their elements; unclosed and misnested tags are mended as they come."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", 0, None, False)
        self.open = [self.root]
        self.many = Counter()  # of each tag among the open ones
        self.elements = [self.root]  # as they come, the outer before the inner
        self.paths: dict[tuple, int] = {}
        self.blocks: list[Block] = []
        self.fresh = True

    def finish(self):
        """Read what is left at the end, but for a comment or a tag that the end cuts off."""
        left = self.rawdata
        if self.cdata_elem is None and (left.startswith("<!--") or _TAG.match(left) and ">" not in left):
            self.rawdata = ""
        self.close()

    def parse_comment(self, i, report=1):
        """A comment ends with ``-->`` or ``--!>``; ``<!-->`` and ``<!--->`` are whole."""
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else -1

    def handle_starttag(self, tag, attrs):
        if tag in INLINE or tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag not in INLINE:
                self.fresh = True
            if tag not in VOID:
                self._enter(tag, attrs)
            return
        self._leave("p")  # a block ends an open paragraph
        for other in CLOSES_ITSELF.get(tag, ()):
            self._leave(other)
        self._enter(tag, attrs)
        self.fresh = True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.fresh = True
            self._leave(tag, far=True)
        else:
            self._leave(tag)

    def handle_data(self, data):
        top = self.open[-1]
        if top.other:
            return
        if self.fresh:
            element = top
            while element.tag in INLINE:
                element = element.parent
            self.blocks.append(Block(element))
            self.fresh = False
        self.blocks[-1].parts.append((data, top.signed))

    def _enter(self, tag, attrs):
        parent, given = self.open[-1], dict(attrs)
        names = f"{given.get('class') or ''} {given.get('id') or ''}".lower()
        tokens = set(_TOKENS.findall(names))
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (
            given.get("style") or "").replace(" ", "").lower()
        signs = SIGNS & set(_TOKENS.findall(_STATE.sub(" ", names))) - ({"header"} if tokens & NAMES else set())
        sign = tag == "form" or tag not in ("html", "body", "main") and bool(signs)
        other = parent.other or tag in NEVER or hidden or (given.get("role") or "").lower() in ROLES
        path = parent.path
        if tag not in INLINE:
            path = self.paths.setdefault((path, tag, *sorted(tokens)), len(self.paths) + 1)
        made = Element(tag, path, parent, other, depth=parent.depth + 1)
        made.outer = parent.outer or (made if tag == "header" else None)
        made.heading = parent.heading or tag in HEADINGS
        made.article = parent.article or (made if tag in ARTICLES else None)
        made.signed = made if sign else parent.signed
        self.open.append(made)
        self.elements.append(made)
        self.many[tag] += 1

    def _leave(self, tag, far=False):
        """Close the nearest open ``tag``; without ``far`` only up to the element that holds it."""
        if not self.many[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.many.subtract(element.tag for element in self.open[at:])
                del self.open[at:]
                return
            if not far and self.open[at].tag in SCOPES and self.open[at].tag != tag:
                return


def path_scores(blocks: list[Block], smooth: float = 1.0) -> np.ndarray:
    """The fused ratio of each block's path, smoothed over the blocks in page order; 0 leaves it as it is."""
    places: dict[int, int] = {}
    of = np.array([places.setdefault(block.element.path, len(places)) for block in blocks])
    chars = np.array([len(block.text) for block in blocks], dtype=float)
    marks = np.array([len(PUNCTUATION.findall(block.text)) for block in blocks], dtype=float)
    many = np.bincount(of)
    ratios = [(np.bincount(of, weights=x) / many)[of] for x in (chars, marks)]
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * smooth**2)) if smooth else (reach == 0).astype(float)
    near = np.convolve(np.ones(len(blocks)), kernel, "full")[2:-2]
    even = [np.convolve(ratio, kernel, "full")[2:-2] / near for ratio in ratios]
    return np.sqrt(even[0] * (1 + even[1]))


def veto_signed(page: Blocks, blocks: list[Block], chosen: list[Block], share: float) -> None:
    """Veto the signed elements that hold less than ``share`` of the selected text, with all in them.

    A page with one article or main element without a sign around it says itself where its
    text is; signed elements outside that are vetoed too. Where nothing of the selected text
    would be left, the signs say nothing.
    """
    held: Counter[int] = Counter()
    total = 0
    for block in chosen:
        for data, element in block.parts:
            size = len("".join(data.split()))
            total += size
            if element is not None:
                held[id(element)] += size
    signed = [element for element in page.elements if element.signed is element]
    for element in reversed(signed):
        if element.parent.signed is not None:
            held[id(element.parent.signed)] += held[id(element)]
    articles = {id(found): found for block in blocks if (found := block.element.article) and not found.signed}
    alone = next(iter(articles.values())) if len(articles) == 1 else None
    for element in signed:
        around = element.parent.signed
        outside = alone is not None and element.article is not alone
        element.vetoed = outside or held[id(element)] < share * total or around is not None and around.vetoed
    if not any(block.read() for block in chosen):
        for element in signed:
            element.vetoed = False


def _beside(blocks: list[Block], chosen: list[Block], scores: dict[int, float], inside: list[bool], level: float) -> list[bool]:
    """Which blocks to keep: those inside, the chosen ones beside whose paths stand inside or score at least
    ``level`` of the mean there, and the headings directly before a kept block."""
    within = [block for block, held in zip(blocks, inside) if held]
    mean = sum(scores[id(block)] for block in within) / max(len(within), 1)
    paths = {block.element.path for block in within}
    selected = {id(block) for block in chosen}
    kept = [
        held or id(block) in selected and (block.element.path in paths or scores[id(block)] >= level * mean)
        for block, held in zip(blocks, inside)
    ]
    for at in range(len(blocks) - 2, -1, -1):
        kept[at] = kept[at] or kept[at + 1] and blocks[at].element.tag in HEADINGS
    return kept


def main_blocks(
    html: str | None, spread: float = 0.5, most: float = 0.9, signed: float = 2 / 3, level: float = 0.5
) -> list[str]:
    """The blocks of the main text in page order, white space turned into single blanks.

    A path is selected from ``spread`` standard deviations of the scores on; the article
    is the smallest element with ``most`` of the selected text, or an article or main
    element around it. Without such an element, selected blocks beside the smallest one that score ``level`` of the
    mean inside, or have a path from inside, belong to it, as do headings directly before. Elements that
    say that they are something else are left out where they hold less than ``signed`` of the selected text.
    Every step is a pass over the elements or blocks, however deep they are nested.
    """
    page = Blocks()
    page.feed(html or "")
    page.finish()
    blocks = []
    for block in page.blocks:
        block.text = block.read()
        if block.text and not block.element.header:
            blocks.append(block)
    if not blocks:
        return []
    scores = path_scores(blocks)
    chosen = [block for block, score in zip(blocks, scores) if score >= spread * scores.std()]
    # beside the article a path speaks for itself, not for its neighbours
    alone = {id(block): float(score) for block, score in zip(blocks, path_scores(blocks, smooth=0))}
    veto_signed(page, blocks, chosen, signed)
    for block in blocks:
        if any(element is not None for _, element in block.parts):
            block.text = block.read()
    blocks, chosen = ([block for block in some if block.text] for some in (blocks, chosen))
    total = float(sum(len(block.text) for block in chosen))
    for block in chosen:
        block.element.held += len(block.text)
    for element in reversed(page.elements[1:]):
        element.parent.held += element.held
    # those with most of the text lie one inside the other; the deepest scope, then the outermost article around it
    around = [x for x in page.elements if x.tag in SCOPES and x.held >= most * total] if chosen else []
    best = max(around, key=lambda x: x.depth, default=page.root)
    article = best.article or best
    within = set()
    for element in page.elements:
        if element is article or element.parent is not None and id(element.parent) in within:
            within.add(id(element))
    inside = [id(block.element) in within for block in blocks]
    kept = inside if best.article else _beside(blocks, chosen, alone, inside, level)
    return [block.text for block, keep in zip(blocks, kept) if keep]


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a line break), n_chars.

    A null html is an empty page and gives an empty text, and so does a page in which
    everything says that it is something else. Rows that repeat are extracted each. Other
    columns are neither read nor returned.
    """

    def extracted(batch: pa.RecordBatch) -> dict[str, list]:
        texts = ["\n".join(main_blocks(html)) for html in batch["html"].to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_rows(
        typed(pages, page_id="bigint", url="string", html="string"),
        extracted,
        "page_id bigint, url string, text string, n_chars bigint",
    )
