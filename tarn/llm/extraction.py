"""HTML extraction: the maximum-scoring run of a page, with weights from labelled pages.

A page is read once as a sequence of tags and words. Tags score below zero; words score above
zero, unless something around them (an element, a class, a role, a block of links) is seen
outside of articles, or their page marks an article that most of its text lies in and they lie beside that. One linear scan
finds the best contiguous run, and the words in it that score above zero are the text. How much each name scores
comes from pages that mark their article themselves, with a few well-known names as prior counts that
these pages can overrule.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import packed, unpacked

#: Labelled pages that the weights are fitted on, at most, and the longest page taken for that.
SAMPLE, SAMPLE_CHARS = 2000, 200_000
#: Prior count behind each well-known name.
PRIOR = 50
#: What a word beside a mark scores at most, where at least half of the text that is worth anything is marked.
BESIDE = -0.25

# Names from the HTML standard and from common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
MARKS = frozenset("article main".split())
MARK_NAMES = frozenset("main articlebody article-body article-content post-content entry-content post-body story-body".split())
CONTAINERS = frozenset("nav header footer aside form menu dialog search button".split())
OUTSIDE = frozenset(
    "nav navbar navigation menu header masthead footer aside sidebar form dialog search ad ads advert advertisement adverts banner sponsor sponsored promo promotion"
    " cookie cookies consent notice alert popup modal newsletter subscribe signup login breadcrumb breadcrumbs pagination pager share sharing social related recommended"
    " widget toolbar comment comments respond replies disqus copyright contentinfo complementary button".split()
)
#: Parts of a compound name by which it states a property of what it is on (no-sidebar, comments-open), not what that is.
STATES = frozenset("no not has have with without is show hide open closed fixed enabled disabled active visible hidden left right".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_token = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_attribute = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_name = re.compile(r"[a-z]+(?:-[a-z]+)*", re.I)


@dataclass
class Node:
    """A text within its surroundings, or (text None) a tag."""

    text: str | None
    tag: str = ""
    names: frozenset[str] = frozenset()
    marked: bool = False
    link: bool = False
    breaks: bool = False
    above: frozenset[str] = frozenset()  # of a marked text: the names around its mark


@dataclass
class Weights:
    """Shares of words, by name around them, and of tags that are inside of articles."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, names: frozenset[str]) -> float:
        return 2 * min((self.words[n] for n in names if n in self.words), default=1.0) - 1

    def tag(self, tag: str) -> float:
        return -0.05 - 2 * (1 - self.tags.get(tag, 0.95))


def names_of(tag: str, attributes: str) -> tuple[frozenset[str], bool, bool]:
    """(names that may tell what an element is, whether it marks an article, whether it is hidden)."""
    names, mark, hidden = set(), tag in MARKS, False
    if tag in CONTAINERS:
        names.add(tag)
    if attributes:
        for m in _attribute.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif kind == "hidden" or kind == "aria-hidden":
                hidden |= kind == "hidden" or value == "true"
            else:
                for word in value.split():
                    mark |= word in MARK_NAMES
                    whole = _name.findall(word)
                    names.update(whole)
                    if tag not in HEADINGS:
                        names.update(p for w in whole if not STATES & set(w.split("-")) for p in w.split("-") if p in OUTSIDE)
    if mark or tag in ("html", "body"):  # what is on all of a page, or on its article, tells no parts apart
        names.clear()
    return frozenset(names - MARK_NAMES), mark, hidden


def parse(page: str) -> list[Node]:
    """Texts and tags of a page in order; whatever can't be seen is left out."""
    nodes: list[Node] = []
    stack: list[tuple[str, frozenset[str], bool, bool, bool, frozenset[str]]] = []  # tag, all names around, marked, link, hidden, names around the mark
    none: frozenset[str] = frozenset()
    at, n, head = 0, len(page), False

    def state():
        return stack[-1] if stack else ("", none, False, False, False, none)

    def text(a: int, b: int) -> None:
        _, names, marked, link, hidden, above = state()
        if a < b and not hidden and not head:
            nodes.append(Node(htmllib.unescape(page[a:b]), names=names, marked=marked, link=link, above=above))

    while at < n:
        m = _token.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "head":
            head = not closing
            continue
        if tag == "body":
            head = False
        if tag in RAW and not closing:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        nodes.append(Node(None, tag, marked=state()[2], breaks=tag in BLOCK))
        if tag == "br":
            _, names, marked, link, _, above = state()
            nodes.append(Node(" ", names=names, marked=marked, link=link, above=above))
        if tag in VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in MARKS | CONTAINERS and tag not in BLOCK:
                    break
            continue
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            stack.pop()
        if tag in BLOCK:  # a paragraph with inline elements left open ends here too
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        _, names, marked, link, hidden, above = state()
        own, mark, gone = names_of(tag, m[3])
        if tag == "header" and marked:
            own -= {"header"}
        stack.append((tag, names | own if own else names, marked or mark, link or tag == "a", hidden or gone, names if mark and not marked else above))
    return nodes


def fit(pages: list[str], prior: frozenset[str] = OUTSIDE) -> Weights:
    """Weights from pages that mark their article: shares of words by name, and of tags, inside of it.

    Every name around a mark counts as inside, so labelled pages can overrule `prior`. Well-known names below a
    mark (an advert within an article) aren't counted: the mark doesn't tell which of these are text.
    """
    inside, total = defaultdict(float), defaultdict(float)
    tags_in, tags = defaultdict(float), defaultdict(float)
    for name in prior:
        total[name] += PRIOR
    for page in pages:
        nodes = parse(page)
        if not any(x.marked for x in nodes):
            continue
        for x in nodes:
            if x.text is None:
                tags[x.tag] += 1
                tags_in[x.tag] += x.marked
            else:
                n = len(x.text.split())
                for name in x.names:
                    if not x.marked or name in x.above or name not in prior:
                        total[name] += n
                        inside[name] += n * x.marked
    words = {k: (inside[k] + 1) / (v + 2) for k, v in total.items()}
    return Weights({k: v for k, v in words.items() if v < 0.5}, {k: (tags_in[k] + 9.5) / (v + 10) for k, v in tags.items()})


def extract(page: str, weights: Weights) -> str:
    """Text of the best run: blocks joined by a line end, white space in each as one space."""
    nodes = parse(page)
    own = [0.0 if x.text is None else weights.word(x.names) * len(x.text.split()) for x in nodes]
    text, marked = (sum(w for w, x in zip(own, nodes) if w > 0 and (x.marked or every)) for every in (True, False))
    mark_holds = 2 * marked >= text > 0
    score = [0.0] * len(nodes)
    block: list[int] = []

    def settle() -> None:
        """A block that is mostly links, outside of any marked article, is a menu."""
        sizes = [len(nodes[k].text.split()) for k in block]
        if 3 * sum(s for s, k in zip(sizes, block) if nodes[k].link and not nodes[k].marked) > 2 * sum(sizes) > 0:
            for k in block:
                score[k] = -abs(score[k])
        block.clear()

    for k, x in enumerate(nodes):
        if x.text is None:
            score[k] = weights.tag(x.tag)
            if x.breaks:
                settle()
        else:
            score[k] = own[k]
            if mark_holds and not x.marked:
                score[k] = min(own[k], BESIDE * len(x.text.split()))
            block.append(k)
    settle()

    best, best_run, run, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(score):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, best_run = run, (start, k + 1)

    blocks, parts = [], []
    for k in range(*best_run):
        x = nodes[k]
        if x.text is None:
            if x.breaks and parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif score[k] > 0 or (not x.text.strip() and weights.word(x.names) > 0 and (x.marked or not mark_holds)):
            parts.append(x.text)
    blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def weights_from(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights fitted on at most `sample` different pages that mark their article.

    Those whose content hash is below a threshold are taken, which by the number of pages lets about
    nine tenths of `sample` pass, so no task sends more than its share to the driver.
    """
    text, wide = F.col(html_col), 1 << 40
    share = int(wide * min(1.0, 0.9 * sample / max(1, pages.count())))
    h = F.xxhash64(text)
    drawn = pages.select(text.alias("html"), h.alias("h")).where(F.pmod(h, F.lit(wide)) < share)
    marked = drawn.where(F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") <= SAMPLE_CHARS))
    return fit([r["html"] for r in marked.dropDuplicates(["h"]).limit(sample).collect()])


def extract_pages(pages: DataFrame, html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """pages with text (empty if none) and n_chars (its code points).

    weights: fitted on `pages` itself if not given. Null or empty html gives an empty text; rows
    may repeat; an empty table gives an empty one. Columns of pages with these names are replaced.
    """
    w = weights or weights_from(pages, html_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), w) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])

    base = pages.select(packed(pages), F.col(html_col).alias("html"))
    out = base.mapInArrow(apply, f"row {base.schema['row'].dataType.simpleString()}, text string, n_chars long")
    return unpacked(out, F.col("text"), F.col("n_chars"))
