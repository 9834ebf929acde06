"""Main text of HTML pages from streaming parser events.

The standard library's parser reads a page once. Every block (paragraph, heading, list item, cell) is a line with
its text, the number of tags in it and the chain of containers around it; what stands in elements that
are never article text (navigation, footers, forms, scripts, or a class, id or role that says so) is left out.
The text-to-tag ratio of the lines is smoothed with a Gaussian over neighbouring lines; lines above the standard deviation of the
ratios form the content cluster. The container that holds that cluster (an article or main element if one
does, else the innermost block that does) is the region; all its lines are the text, so short paragraphs
between long ones are not lost, and so are lines of the cluster beside it (a lead paragraph in a block of its own), unless
an article or main element holds nearly all of the cluster.

A name alone does not remove a page: an element left out for its class or id, or a form, is kept if an article or main
element stands in it, or if it holds nearly all text of the page (reader comments excepted). A head that was never
closed ends at the first element that cannot be in it.

Character references are decoded, white space within a block becomes one space, blocks are joined by one space. A null or
empty page, and a page without text, gives an empty text. Pages are read alone, whole; repeated rows
repeat. Unclosed and wrongly nested elements end where an enclosing one does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import extended

SIGMA = 1.0
REACH = 3
#: Share of the content cluster that a region has to hold.
HOLDS = 0.8

# Elements of HTML by what they mean here.
NEVER = {
    "script", "style", "noscript", "template", "head", "nav", "footer", "aside", "button", "select", "textarea",
    "iframe", "object", "svg", "math", "canvas", "audio", "video", "dialog", "menu",
}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "table", "td", "header", "ul", "ol", "dl", "figure", "center"}
BREAKS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "th", "pre", "blockquote", "br", "hr", "figcaption",
    "caption", "address", "details", "summary", "tbody", "thead", "tfoot", "fieldset", "legend", "option", "title",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words in a class or id that mark what is not the article.
SIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "promotion", "related", "replies",
    "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
COMMENT_WORDS = {"comment", "comments", "disqus", "replies", "respond"}
LAYOUT_WORDS = {"has", "no", "with", "without"}
RELATED_TO = {"articles", "content", "items", "links", "news", "pages", "posts", "products", "reading", "stories", "topics", "videos"}
HEAD_ONLY = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
ENDS_ITSELF = {"p", "li", "dt", "dd", "tr", "th", "option"}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story"}
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def side_words(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words in class or id that mark what is not the article."""
    found = set()
    for name, value in attrs:
        if name not in ("class", "id") or not value:
            continue
        words = set()
        for token in _CAMEL.sub("-", value).lower().split():
            parts = _WORD.findall(token)
            for k, word in enumerate(parts):
                if word not in SIDE_WORDS or (k and parts[k - 1] in LAYOUT_WORDS):
                    continue
                if word == "related" and len(parts) > k + 1 and parts[k + 1] not in RELATED_TO:
                    continue
                words.add(word)
        if not (words <= {"header", "banner"} and MAIN_WORDS & set(_WORD.findall(_CAMEL.sub(" ", value).lower()))):
            found |= words
    return found


def aside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is none of the article's text, whatever it holds."""
    if tag in NEVER:
        return True
    if tag == "header":
        return not in_article
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "aria-hidden":
            if value.strip().lower() == "true":
                return True
        elif name == "style":
            if "display:none" in value.replace(" ", "").lower():
                return True
    return False


class Lines(HTMLParser):
    """The lines of a page: text, tags, containers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []  # text, tags, innermost container
        self.stack: list[tuple[str, int]] = [("", 0)]  # open containers: tag, number; 0 is the page
        self.open: Counter[str] = Counter()
        self.kinds: list[str] = [""]
        self.parent: list[int] = [0]  # numbers grow in page order, so a parent's is lower
        self.named: dict[int, set[str]] = {}  # containers that a name (or being a form) leaves out
        self.whole: set[int] = set()  # those of them that hold an article
        self.article = 0
        self.skipped: list[str] = []  # open elements inside what is left out
        self.text: list[str] = []
        self.tags = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1][1]))
            self.tags = 0
        self.text.clear()

    def _open(self, tag: str) -> int:
        self.parent.append(self.stack[-1][1])
        self.stack.append((tag, len(self.kinds)))
        self.kinds.append(tag)
        self.open[tag] += 1
        self.article += tag in ("article", "main")
        return len(self.kinds) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skipped and tag in ("article", "main") and self.skipped[0] in ("nav", "header", "menu"):
            # these do not hold articles: the element was never closed
            self.skipped.clear()
        if self.skipped == ["head"] and tag not in HEAD_ONLY:
            self.skipped.clear()
        if self.skipped:
            if tag not in VOID and (tag in NEVER or tag == self.skipped[0]):
                self.skipped.append(tag)
            return
        self.tags += 1
        if self.stack[-1][0] in ENDS_ITSELF and (tag == self.stack[-1][0] or self.stack[-1][0] == "p" and tag in CONTAINERS | BREAKS - {"br"}):
            self._close(self.stack[-1][0])
        if tag in VOID:
            if tag in BREAKS:
                self._flush()
            return
        if aside(tag, attrs, self.article > 0):
            self._flush()
            self.skipped.append(tag)
            return
        words = side_words(attrs) if attrs and tag not in ("html", "body", "main") else set()
        if tag == "form" or (words and tag != "article"):
            self._flush()
            self.named[self._open(tag)] = words
        elif tag in CONTAINERS:
            self._flush()
            if tag == "main" or (tag == "article" and not words):
                self._holds_article(tag)
            self._open(tag)
        elif tag in BREAKS:
            self._flush()
        elif self.open[tag]:
            # so that the end of this one does not end the outer one
            self._open(tag)

    def _holds_article(self, tag: str) -> None:
        for _, number in reversed(self.stack):
            if number in self.whole:
                break
            if number in self.named and (tag == "main" or not self.named[number] & COMMENT_WORDS):
                self.whole.add(number)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in NEVER:
            # HTML knows no self-closing elements but the void ones
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            elif self.open[tag] and tag in ("article", "main", "body", "html"):
                # the element left out was never closed
                self.skipped.clear()
                self._close(tag)
            return
        self.tags += 1
        if tag in BREAKS:
            self._flush()
        self._close(tag)

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            return
        if tag in CONTAINERS or any(number in self.named for open_tag, number in self.stack if open_tag == tag):
            self._flush()
        while True:
            ended, _ = self.stack.pop()
            self.open[ended] -= 1
            self.article -= ended in ("article", "main")
            if ended == tag:
                break

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.text.append(data)

    def within(self, weights: list[tuple[int, float]]) -> list[float]:
        """Sum of weights, given with their innermost container, in every container."""
        held = [0.0] * len(self.kinds)
        for number, weight in weights:
            held[number] += weight
        for number in range(len(held) - 1, 0, -1):
            held[self.parent[number]] += held[number]
        return held

    def inside(self, chosen: set[int]) -> list[bool]:
        """For every container, whether it is one of ``chosen`` or within one."""
        out = [0 in chosen]
        for number in range(1, len(self.kinds)):
            out.append(number in chosen or out[self.parent[number]])
        return out

    def shown(self) -> list[tuple[str, int, int]]:
        """The lines outside elements that their names leave out."""
        if not self.named:
            return self.lines
        held = self.within([(number, len(text)) for text, _, number in self.lines])
        gone = self.inside({
            number for number, words in self.named.items()
            if number not in self.whole
            and (held[number] < HOLDS * held[0] or self.kinds[number] == "form" or words & COMMENT_WORDS)
        })
        return [line for line in self.lines if not gone[line[2]]]

    def unknown_decl(self, data: str) -> None:
        pass

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def read(self, html: str) -> Lines:
        self.feed(html)
        self.close()
        self._flush()
        return self


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the ends over those there are."""
    kernel = np.array([math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-REACH, REACH + 1)])
    whole = np.convolve(ratios, kernel)[REACH : REACH + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[REACH : REACH + len(ratios)]


def main_text(html: str) -> str:
    """The text of the content region of a page, and of the content beside it."""
    page = Lines().read(html)
    lines = page.shown()
    if not lines:
        return ""
    size = np.array([len(text) for text, _, _ in lines], float)
    ratio = smoothed(size / np.maximum(1, [tags for _, tags, _ in lines]))
    content = ratio >= min(ratio.std(), ratio.max())
    cluster = np.flatnonzero(content).tolist()
    held = page.within([(lines[k][2], size[k]) for k in cluster])
    count = page.within([(lines[k][2], 1) for k in cluster])
    # the innermost comes last; the page itself holds everything
    fit = [n for n in range(len(held)) if held[n] >= HOLDS * held[0] and count[n] >= HOLDS * count[0]]
    articles = page.inside({n for n, kind in enumerate(page.kinds) if kind == "article"})
    in_articles = sum(size[k] for k in cluster if articles[lines[k][2]])
    mains = {n for n, kind in enumerate(page.kinds) if kind == "main" and held[n] >= 0.5 * held[0]}
    if in_articles >= 0.5 * held[0]:
        region, share = articles, in_articles
    elif mains:
        region, share = page.inside(mains), max(held[n] for n in mains)
    else:
        region, share = page.inside({fit[-1]}), 0.0
    beside = content if share < HOLDS * held[0] else np.zeros(len(lines), bool)
    return " ".join(text for (text, _, number), own in zip(lines, beside) if own or region[number])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` of every page."""
    rows = pages.select(*keep, F.col(html).cast("string").alias("__html"))
    fields = extended(rows.select(*keep).schema, "text string, n_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                texts = [main_text(page.as_py() or "") for page in part.column("__html")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    fields.names,
                )

    return rows.mapInArrow(run, fields)
