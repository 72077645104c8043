"""Main text of web pages: parser events make lines, a smoothed text-to-tag ratio finds the content among them.

A line is a run of text between block-level tags.  Its ratio is its length without links over the tags that opened in it and
before it.  Ratios of all shown lines, menus and footers too, are smoothed with a Gaussian along the page and split in two
clusters at a threshold; lines of the high cluster are content.  The region is the innermost container that holds most of the
content, where text in an article element counts several times and such an element is not looked into further.  Of its lines
go those in parts that are never article text (menus, forms, adverts, reader comments), and runs of links in the low cluster.

Pages are tidied before they are parsed: comments and declarations go, scripts and styles are emptied, and tags that are not
written as they should be are written anew, each construct being looked at once.  The parser keeps parents, counts and depths of
open elements.  So the work grows with the page, however deep it is nested and whatever is left unclosed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import sliced, table

NAME = "op3_html_text"
SQL = None  # SQL doesn't parse HTML
SIGMA = 1.5
#: Share of the content's text that a container must hold to be the region, and how often text in an article element counts.
MOST, PRIOR = 0.7, 3
#: Share of the content's text that makes a form, or a part named like a menu, a wrapper of the article.
WRAPPER = 0.9
#: A region without article element takes in its parent if that adds no more text than this share of its own.
HEADINGS = 0.15
#: Links one after another that are a menu.
MENU = 2
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a line.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav noscript ol option p pre script search section select style summary table tbody td textarea tfoot th thead title tr ul".split()
)
#: Elements that set apart regions of a page.
CONTAINERS = set("article center div main section td".split())
#: Elements whose text is never shown as text.
UNSEEN = set("script style noscript template iframe object svg math canvas head title textarea select option button datalist audio video map".split())
#: Elements that hold no article text.
ASIDE = set("nav footer aside menu dialog search".split())
#: The same, unless they are wrapped around the article.
FORMS = set("form fieldset".split())
#: Words of class and id that mark such parts.
MARKS = set(
    "ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs cookie cookies consent copyright disclaimer footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommendations recommended related share sharing sidebar sidebars social sponsor sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
#: Words that mark reader comments.
READERS = set("comment comments commentlist disqus discussion replies reply respond".split())
#: Words that may stand beside a mark in one name: "site-footer", "cookie-box-inner".
BESIDE = set(
    "area article articles bar body bottom box block button buttons container content entry footer form global group header holder icons inner item items left level link links list local main outer page panel post posts primary right row section secondary signup site slot story sub top unit wrap wrapper".split()
)
#: With one of these words beside it, "header" means the head of the article.
OWN = set("article content entry post story".split())
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An end tag other than these doesn't leave the part it stands in.
PARTS = set("article main body nav footer aside table".split())
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: A tag as it should be; what follows a name or a value is not tried again otherwise.
_TAG = re.compile(r"""</?+[A-Za-z][A-Za-z0-9:-]*+(?:\s++[A-Za-z_:][\w:.-]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+\s*+/?+>""")
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_GAP = re.compile(r"[\s/]*+")
#: Attributes that are looked at.
_USED = ("class", "id", "role", "hidden", "aria-hidden", "style")
#: Elements whose content is no markup.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}


def _rewritten(html: str, at: int) -> tuple[str, int]:
    """The tag that begins at a place, written as it should be, and where it ends; one that never ends takes all the rest, unseen."""
    name = _NAME.match(html, at)
    end, kept = name.end(), []
    while True:
        end = _GAP.match(html, end).end()
        if end == len(html):
            return "", end
        if html[end] == ">":
            break
        m = _ATTRIBUTE.match(html, end)
        end, value = m.end(), None
        if m[2]:
            quote = html[end : end + 1]
            close = html.find(quote, end + 1) if quote in ("'", '"') else -1
            if close >= 0:
                value, end = html[end + 1 : close], close + 1
            else:
                bare = _BARE.match(html, end)
                value, end = bare[0], bare.end()
        if m[1].lower() in _USED:
            kept.append(f" {m[1]}" if value is None else f' {m[1]}="{value.replace(chr(34), "&quot;")}"')
    plain = re.sub(r"[^A-Za-z0-9:-]", "-", name[1])
    return ("</" + plain if html[at + 1] == "/" else "<" + plain + "".join(kept)) + ">", end + 1


def tidied(html: str) -> str:
    """The page without comments, declarations and contents of scripts and styles, all its tags well written."""
    out, at, end = [], 0, len(html)
    while at < end:
        open_ = html.find("<", at)
        if open_ < 0:
            open_ = end
        out.append(html[at:open_])
        at, after = open_, html[open_ + 1 : open_ + 3]
        if at == end:
            break
        if html.startswith("<!--", at):
            close = html.find("-->", at + 2)
            at = end if close < 0 else close + 3
        elif after[:1] in ("!", "?") or after[:1] == "/" and len(after) > 1 and not (after[1].isascii() and after[1].isalpha()):
            close = html.find(">", at + 1)
            at = end if close < 0 else close + 1
        elif _NAME.match(html, at):
            m = _TAG.match(html, at)
            tag, at = (m[0], m.end()) if m else _rewritten(html, at)
            out.append(tag)
            name = tag[1:7].lower()
            raw = next((k for k in _RAW if name.startswith(k) and not tag[len(k) + 1 : len(k) + 2].isalnum() and tag[len(k) + 1 : len(k) + 2] not in (":", "-")), None)
            if raw:
                m = _RAW[raw].search(html, at)
                at = m.start() if m else end
        else:
            out.append("&lt;")
            at += 1
    return "".join(out)


@dataclass
class Line:
    text: str  # of parts that may hold article text
    tags: int
    links: int  # characters in links
    node: int
    shown: int  # characters of all parts


class Lines(HTMLParser):
    """The elements of a page by number, parents first, and its lines."""

    #: Why an element is left out: never article text; unless it is wrapped around the article.
    OUT, UNLESS = 1, 2

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.why, self.container, self.article = [0], [0], [True], [""]
        self.hidden, self.inside = [False], [0]  # of each element: never shown; the article element around it, or 0
        self.open: list[tuple[str, int]] = []
        self.depth: dict[str, list[int]] = {}  # depths at which elements of a name are open
        self.blocks: list[int] = []
        self.parts: list[int] = []
        self.found: list[tuple[int, list[tuple[str, int, bool]], int]] = []
        self.buffer: list[tuple[str, int, bool]] = []
        self.tags = 0

    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        if any(not x.isspace() for x, _, _ in self.buffer):
            self.found.append((self.here(), self.buffer, self.tags))
            self.tags = 0
        self.buffer = []

    def reason(self, tag: str, a: dict) -> int:
        if tag in ASIDE or tag == "header" and not self.inside[self.here()]:
            return self.OUT
        if tag in FORMS:
            return self.UNLESS
        if tag in ("html", "body"):
            return 0
        if (a.get("role") or "").lower() in ROLES:
            return self.OUT
        reason = 0
        for name in (*(a.get("class") or "").split(), *(a.get("id") or "").split()):
            words = {w.lower() for w in _PART.findall(name)}
            if "header" in words and (words & OWN or self.inside[self.here()]):
                words.discard("header")  # the heading of the article itself
            if words & READERS and words <= READERS | MARKS | BESIDE:
                return self.OUT
            if words & MARKS and words <= MARKS | BESIDE and tag not in ("article", "main"):
                reason = self.UNLESS
        return reason

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCK:
            self.close_implied("p")
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd"):
            self.close_implied(tag)
        a, up = dict(attrs), self.here()
        main = tag in ("article", "main") or a.get("role") == "main"
        n = len(self.parent)
        self.parent.append(up)
        self.why.append(self.reason(tag, a))
        self.container.append(tag in CONTAINERS)
        self.article.append(tag if main else "")
        unseen = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in (a.get("style") or "").replace(" ", "").lower()
        self.hidden.append(self.hidden[up] or unseen)
        self.inside.append(self.inside[up] or (n if main else 0))
        at = len(self.open)
        self.depth.setdefault(tag, []).append(at)
        if tag in BLOCK:
            self.blocks.append(at)
        if tag in PARTS:
            self.parts.append(at)
        self.open.append((tag, n))

    def close(self, at: int | None = None) -> None:
        """Close the elements from a depth on, or the parser."""
        if at is None:
            super().close()
            return
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.depth[tag].pop()
            for depths in (self.blocks, self.parts):
                if depths and depths[-1] == len(self.open):
                    depths.pop()

    def close_implied(self, tag: str) -> None:
        """A new block closes an open paragraph, a new item its fellow, if nothing else of block kind is open in between."""
        if self.blocks and self.open[self.blocks[-1]][0] == tag:
            self.close(self.blocks[-1])

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if tag in VOID or not self.depth.get(tag):
            return
        at = self.depth[tag][-1]
        if not self.parts or at >= self.parts[-1] or tag in PARTS or tag in ("html", "section", "div"):
            self.close(at)

    def handle_data(self, data):
        if not self.hidden[self.here()]:
            self.buffer.append((data, self.here(), bool(self.depth.get("a"))))

    def left_out(self, wrappers: set[int] | None) -> list[bool]:
        """Of each element: whether its text is left out; wrappers are not, and nothing that might be one if they are None."""
        out = [False] * len(self.parent)
        for n in range(1, len(out)):
            may = self.why[n] == self.UNLESS and (wrappers is None or n in wrappers)
            out[n] = out[self.parent[n]] or self.why[n] > 0 and not may
        return out

    def lines(self, out: list[bool]) -> list[Line]:
        """All shown lines; what is left out is not in their text."""
        made = []
        for node, parts, tags in self.found:
            shown = _SPACE.sub(" ", "".join(x for x, _, _ in parts)).strip()
            text = _SPACE.sub(" ", "".join(x for x, n, _ in parts if not out[n])).strip()
            made.append(Line(text, tags, sum(len(x) for x, _, link in parts if link and not x.isspace()), node, len(shown)))
        return made


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian over neighbours, up to three sigma away; weights at the ends sum to one, too."""
    r = math.ceil(3 * sigma)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - r), min(len(values), i + r + 1)
        part = w[lo - i + r : hi - i + r]
        out.append(sum(x * y for x, y in zip(values[lo:hi], part, strict=True)) / sum(part))
    return out


def two_clusters(values: list[float]) -> float:
    """The threshold that splits values into two clusters, as k-means with two centres settles; the least value if all are alike."""
    lo, hi = min(values), max(values)
    while True:
        cut = (lo + hi) / 2
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not low or not high:
            return min(values)
        new = sum(low) / len(low), sum(high) / len(high)
        if new == (lo, hi):
            return cut
        lo, hi = new


def ratios(lines: list[Line]) -> list[float]:
    return [max(0, x.shown - x.links) / max(1, x.tags) for x in lines]


def upwards(page: Lines, at_node: list[float]) -> list[float]:
    """Sums over elements and all that lies in them; children come after their parents."""
    for n in range(len(at_node) - 1, 0, -1):
        at_node[page.parent[n]] += at_node[n]
    return at_node


def weights(page: Lines, lines: list[Line], content: list[bool]) -> list[float]:
    """Characters of content in every element, those in an article element several times."""
    weight = [0.0] * len(page.parent)
    for line, good in zip(lines, content, strict=True):
        if good:
            weight[line.node] += len(line.text) * (PRIOR if page.inside[line.node] else 1)
    return upwards(page, weight)


def region(page: Lines, lines: list[Line], content: list[bool]) -> list[bool]:
    """Which elements belong to the container that holds most of the content."""
    weight, text = weights(page, lines, content), [0] * len(page.parent)
    for line in lines:
        text[line.node] += len(line.text)
    upwards(page, text)
    most = [n for n, w in enumerate(weight) if w >= MOST * weight[0] and page.container[n]]  # each lies in the one before
    articles = [n for n in most if page.article[n]]
    best = next((n for n in articles if page.article[n] == "article"), articles[-1] if articles else most[-1])
    if not articles:
        while best and text[page.parent[best]] <= (1 + HEADINGS) * text[best]:
            best = page.parent[best]
    inside = [False] * len(page.parent)
    for n in range(len(inside)):
        inside[n] = n == best or n > 0 and inside[page.parent[n]]
    return inside


def main_text(html: str | None) -> str:
    """The article of a page: its lines, two line feeds between them."""
    if not html:
        return ""
    page = Lines()
    page.feed(tidied(html))
    page.close()
    page.flush()
    lines = page.lines(page.left_out(None))
    if not lines:
        return ""
    # Text that can't be the article's takes part in ratios and clusters, but not in the choice of the region.
    ratio = smoothed(ratios(lines))
    cut = two_clusters(ratio)
    high = [r >= cut and x.links < x.shown for r, x in zip(ratio, lines, strict=True)]
    weight = weights(page, lines, high)
    wrappers = {n for n, why in enumerate(page.why) if why == page.UNLESS and weight[n] > 0 and weight[n] >= WRAPPER * weight[0]}
    lines = page.lines(page.left_out(wrappers))
    content = [good and bool(x.text) for good, x in zip(high, lines, strict=True)]
    if not any(content):
        content = [bool(x.text) and x.links < x.shown for x in lines]
    if not any(content):
        return ""
    inside = region(page, lines, content)
    kept = [(x, good) for x, good in zip(lines, content, strict=True) if x.text and inside[x.node]]
    menu, at = [], 0
    while at < len(kept):
        end = at
        while end < len(kept) and not kept[end][1] and kept[end][0].links >= len(kept[end][0].text):
            end += 1
        if end - at >= MENU:
            menu += range(at, end)
        at = max(end, at + 1)
    gone = set(menu)
    return "\n\n".join(x.text for k, (x, _) in enumerate(kept) if k not in gone)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages: the main text of its whole html.

    Null html, and pages without article text, give the empty string.  Null and repeated ids pass through; an empty table
    gives none; columns other than page_id, url and html are not read.  Unclosed elements end with the part they stand in; a tag
    or comment that never ends hides what follows, as in a browser; declarations and "<![" sections are no text.  A form,
    or a part with a class like those of menus, is not left out if it holds nearly all content of the page.
    """
    kinds = dict(pages.dtypes)

    def run(batches):
        for b in sliced(batches):
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
