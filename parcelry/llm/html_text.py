"""HTML extraction: parser events become lines; smoothed text-to-tag ratios pick the content regions.

A page is read once through the standard library's event parser. Every block of text is a line with its characters, the tags
within it and the elements around it. Lines inside menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are marked. What a word of a class, id or role marks keeps its text until the whole page is read, as such words also name
wrappers of the article: see `excluding`. The text-to-tag ratio per line, smoothed with a Gaussian kernel, is split by a threshold between two
clusters. Where articles or mains hold most of the upper cluster's characters, the largest is the article, with its siblings of some size. Else the cluster alone decides: from the
page's root on, into the element that holds nearly all of its characters, as long as there is one. All unmarked lines of the article
are kept, whatever their own ratio, so that short paragraphs between long ones stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from parcelry.llm.shared import small_batches

#: Elements that start and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never an article's.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg canvas object head title button select textarea dialog menu audio video".split())
#: Elements whose content is text up to their end tag, whatever it holds; all but xmp are dropped.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that can be a region.
REGIONS = frozenset("article main".split())
#: Words of class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion promoted "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Elements that a new block of the same kind closes, where the page leaves them open.
CLOSES = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Words that mark nothing inside an article or main, where they name its own heading.
HEADING = frozenset(("header", "masthead", "banner"))
#: Words that name a container: beside a mark in a class, they leave it one.
CONTAINERS = frozenset("area bar block bottom box btn button buttons container content group icon icons inner item items left link links list outer panel post posts right section slot stories top unit wrap wrapper".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_STOP = re.compile(r"[>\"']")
#: Marks within marks, and articles within articles, that are told apart; the text of deeper ones goes with the one around them.
DEEPEST = 32
#: Of the characters that count, the share that an element must hold for the article to lie in it; and of the largest article's, what its siblings must have.
NEARLY_ALL, SIBLING = 0.8, 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def marking(key: str, value: str, inside: bool) -> bool:
    """Whether a class, id or role marks its element.

    Within an article an id does only by its last word, and a class only if one of its names has a mark and else no words but marks, containers and numbers ("related-posts", not
    "related-work"), as other names are those of sections.
    """
    if not inside:
        return not MARKS.isdisjoint(w for w in _SPLIT.split(value.lower()) if w)
    for name in value.lower().split():
        found = [w for w in _SPLIT.split(name) if w and w not in HEADING]
        if key == "id":
            found = found[-1:]
        if not MARKS.isdisjoint(found) and all(w in MARKS or w in CONTAINERS or w.isdigit() for w in found):
            return True
    return False


def tag_end(html: str, start: int, gone: set[str]) -> int:
    """After the '>' that ends the tag at start, or -1; quoted values may hold '>'. gone: quotes that no later place closes."""
    at = start + 1
    while True:
        stop = _STOP.search(html, at)
        if stop is None or stop[0] == ">":
            return -1 if stop is None else stop.end()
        at, quote, before = stop.end(), stop[0], stop.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and quote not in gone:
            close = html.find(quote, at)
            if close < 0:
                gone.add(quote)
            else:
                at = close + 1


def feed_whole(parser: _Lines, html: str) -> None:
    """Feeds a page in whole constructs, in one pass: the parser never meets an unfinished one, which it would read again and again.

    Comments, declarations and processing instructions are left out, as is all that follows one (or a tag, or raw text) without
    an end.
    """
    at, gone = 0, set()
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            parser.feed(html[at:])
            return
        if start > at:
            parser.feed(html[at:start])
        after = html[start + 1 : start + 2]
        closing = after == "/" and html[start + 2 : start + 3].isalpha()
        if closing or after.isascii() and after.isalpha():
            at = tag_end(html, start, gone)
            if at < 0:
                return
            parser.feed(html[start:at])
            name = _NAME.match(html, start + 1)[0].lower() if not closing else ""
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                if end is None:
                    return
                if name == "xmp":
                    parser.feed(html[at : end.start()])
                elif end.start() > at:
                    parser.handle_data(html[at : end.start()])
                at = end.start()
        elif after in ("!", "?", "/") and after:
            mark = "-->" if html.startswith("<!--", start) else ">"
            end = html.find(mark, start + 2)
            if end < 0:
                return
            at = end + len(mark)
        else:
            parser.feed("&lt;")
            at = start + 1


_NAME = re.compile(r"[^\s/>]+")


class _Lines(HTMLParser):
    """Collects (pieces, hidden, tags, regions, block, linked) per line; dropped text isn't kept. block is the element that the line is in, linked how many characters are in links.

    A piece is text with the marks around it: numbers of elements with a word of MARKS. around: of each mark, the regions
    around it. held: of each mark, the regions that it holds or is.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, tuple[int, ...]]], bool, int, tuple[int, ...], int, int]] = []
        self.open: list[tuple[str, bool, int, bool]] = []  # element, whether it drops its text, its region or -1, whether it is marked
        self.elements: list[tuple[str, int]] = [("", -1)]  # blocks: element and the block around it, a lower number
        self.inner = 0
        self.siblings: list[tuple[int, ...]] = []  # of each region, those around it
        self.linked = 0
        self.marks: tuple[int, ...] = ()
        self.around: list[tuple[int, ...]] = []
        self.held: list[list[int]] = []
        self.blocks: list[int] = []  # where in open the blocks are
        self.names: Counter[str] = Counter()
        self.dropping = 0
        self.regions: tuple[int, ...] = ()
        self.count = 0
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0
        self.hidden = False

    def end_line(self) -> None:
        if self.hidden or any(marks or not text.isspace() for text, marks in self.parts):
            self.lines.append((self.parts, self.hidden, self.tags, self.regions, self.inner, self.linked))
            self.tags = 0
        self.parts, self.hidden, self.linked = [], False, 0

    def pop(self) -> None:
        name, drops, region, marked = self.open.pop()
        self.names[name] -= 1
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
            self.inner = self.elements[self.inner][1]
        self.dropping -= drops
        if region >= 0:
            self.regions = self.regions[:-1]
        if marked:
            self.marks = self.marks[:-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        else:
            self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            closed, scope = CLOSES.get(tag, ("p",)), SCOPE.get(tag, ())
            keep = len(self.open)
            for at in reversed(self.blocks):
                name = self.open[at][0]
                if name in scope or name not in closed:
                    break
                keep = at
            while len(self.open) > keep:
                self.pop()
        inside = bool(self.regions)
        drops = tag in DROPPED or tag == "header" and not inside
        marked = False
        if not drops and not self.dropping and attrs and tag not in ("html", "body"):
            for key, value in attrs:
                if key in ("class", "id", "role") and value and len(self.marks) < DEEPEST and marking(key, value, inside):
                    marked = True
                    self.marks += (len(self.held),)
                    self.held.append([])
                    self.around.append(self.regions)
                    break
        region = -1
        if tag in REGIONS and not drops and len(self.regions) < DEEPEST:
            self.siblings.append(self.regions)
            region = self.count
            self.count += 1
            self.regions += (region,)
            for mark in self.marks:
                self.held[mark].append(region)
        self.dropping += drops
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
            self.elements.append((tag, self.inner))
            self.inner = len(self.elements) - 1
        self.open.append((tag, drops, region, marked))
        self.names[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        else:
            self.tags += 1
        while self.names[tag] and self.open:
            last = self.open[-1][0]
            self.pop()
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.dropping:
            self.hidden = True
        else:
            self.parts.append((data, self.marks))
            if self.names["a"]:
                self.linked += len(data.strip())


def smoothed(ratios: list[float], sigma: float = 1.5) -> list[float]:
    """A Gaussian kernel over the lines' ratios; at the ends the kernel's weights are renormalised."""
    reach = int(3 * sigma)
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        part = kernel[low - i + reach : high - i + reach]
        out.append(sum(a * b for a, b in zip(ratios[low:high], part, strict=True)) / sum(part))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters of the values: iterated midpoint of the two means."""
    at = sum(values) / len(values)
    for _ in range(32):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low or not high:
            return at if high else min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def read_lines(parser: _Lines, excluded: set[int]) -> list[tuple[str, int, bool, tuple[int, ...], int, int]]:
    """(text, tags, marked, regions, block, linked) per line, without the text in excluded marks."""
    lines, carried = [], 0
    for pieces, hidden, tags, regions, block, linked in parser.lines:
        shown = [text for text, marks in pieces if excluded.isdisjoint(marks)]
        text = " ".join("".join(shown).split())
        carried += tags
        if text or hidden or len(shown) < len(pieces):
            lines.append((text, carried, not text, regions, block, linked))
            carried = 0
    return lines


def excluding(parser: _Lines) -> set[int]:
    """The marks that exclude their elements.

    A mark that holds, or is, an article or main doesn't exclude if the largest of them has text, and not less than the
    article or main around the mark has without marks (else the largest unmarked one on the page). Any other mark doesn't exclude
    if it holds most of the high-ratio text, found with all marked text kept, and no article or main is left with text.
    """
    excluded = set(range(len(parser.held)))
    lines = [(pieces, regions, tags) for pieces, _, tags, regions, *_ in parser.lines]
    sizes = [len(" ".join("".join(text for text, _ in pieces).split())) for pieces, _, _ in lines]
    lines = [(*line, size) for line, size in zip(lines, sizes, strict=True) if size]
    if not excluded or not lines:
        return excluded
    ratios = smoothed([size / (1 + tags) for _, _, tags, size in lines])
    limit = threshold(ratios)
    texts = [(len(" ".join(text.split())), marks, regions, r >= limit) for (pieces, regions, _, _), r in zip(lines, ratios, strict=True) for text, marks in pieces]

    clear: dict[int, int] = {}
    by_text: dict[int, list[int]] = {mark: [] for mark in excluded}
    for i, (_, marks, _, _) in enumerate(texts):
        for mark in marks:
            by_text[mark].append(i)

    def count(which) -> None:
        """Adds the texts in no excluded mark to their regions."""
        for i in which:
            size, marks, regions, _ = texts[i]
            if excluded.isdisjoint(marks):
                for region in regions:
                    clear[region] = clear.get(region, 0) + size

    count(range(len(texts)))
    largest = max(clear.values(), default=0)
    whole, by_mark, total = {}, dict.fromkeys(excluded, 0), 0
    for size, marks, regions, high in texts:
        total += size * high
        for region in regions:
            whole[region] = whole.get(region, 0) + size
        for mark in marks:
            by_mark[mark] += size * high
    best = {mark: max(whole.get(region, 0) for region in held) for mark, held in enumerate(parser.held) if held}
    for mark in sorted(best, key=lambda m: (-best[m], m)):
        rival = max((clear.get(region, 0) for region in parser.around[mark]), default=0) or largest
        if best[mark] and best[mark] >= rival:
            excluded.discard(mark)
            count(by_text[mark])
    if not any(clear.values()):
        excluded -= {mark for mark in excluded if 2 * by_mark[mark] > total}
    return excluded


def main_text(html: str | None) -> str:
    """The article's text: lines joined by one space; '' for null, empty or textless pages."""
    if not html:
        return ""
    parser = _Lines()
    feed_whole(parser, html)
    parser.close()
    parser.end_line()
    lines = read_lines(parser, excluding(parser))
    if not lines:
        return ""
    # Marked lines count as text-free: their ratio is 0.
    ratios = smoothed([0.0 if marked else len(text) / (1 + tags) for text, tags, marked, *_ in lines])
    limit = threshold(ratios)
    chosen = [not line[2] and r >= limit for line, r in zip(lines, ratios, strict=True)]
    if not any(chosen):
        chosen = [not line[2] for line in lines]
    by_region: dict[int, int] = {}
    total = 0
    for (text, _, _, regions, *_), yes in zip(lines, chosen, strict=True):
        if yes:
            total += len(text)
            if regions:
                for region in regions:
                    by_region[region] = by_region.get(region, 0) + len(text)
    best = max(by_region, key=lambda r: (by_region[r], r), default=-1)
    if best >= 0:
        beside = {r for r, size in by_region.items() if parser.siblings[r] == parser.siblings[best] and size >= SIBLING * by_region[best]}
        if 2 * sum(by_region[r] for r in beside) >= total:
            return " ".join(text for text, _, marked, regions, *_ in lines if not marked and not beside.isdisjoint(regions))
    return clustered(parser.elements, lines)


def clustered(elements: list[tuple[str, int]], lines: list[tuple[str, int, bool, tuple[int, ...], int, int]]) -> str:
    """The text of the element in which nearly all text of the upper cluster lies; characters in links don't count.

    If that is the page itself, the text from the first to the last line of the cluster, with the headings right before.
    """
    own = [0 if marked else max(0, len(text) - linked) for text, _, marked, _, _, linked in lines]
    ratios = smoothed([n / (1 + line[1]) for n, line in zip(own, lines, strict=True)])
    limit = threshold(ratios)
    chosen = [n > 0 and 2 * n >= len(line[0]) and max(r, n / (1 + line[1])) >= limit for n, line, r in zip(own, lines, ratios, strict=True)]
    if not any(chosen):
        chosen = [n > 0 for n in own] if any(own) else [not line[2] for line in lines]
    held = [0] * len(elements)
    for n, line, yes in zip(own, lines, chosen, strict=True):
        held[line[4]] += n * yes
    children: list[list[int]] = [[] for _ in elements]
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][1]] += held[e]
        children[elements[e][1]].append(e)
    at = 0
    while held[at] and (inner := max(children[at], key=lambda e: held[e], default=None)) is not None and held[inner] >= NEARLY_ALL * held[at]:
        at = inner
    within = [False] * len(elements)
    within[at] = True
    for e in range(at + 1, len(elements)):
        within[e] = within[e] or within[elements[e][1]]
    if at and elements[at][0] not in ("html", "body"):
        return " ".join(line[0] for line in lines if not line[2] and within[line[4]])
    yes = [i for i, c in enumerate(chosen) if c]
    if not yes:
        return ""
    first = yes[0]
    while first > 0 and not lines[first - 1][2] and elements[lines[first - 1][4]][0] in HEADINGS:
        first -= 1
    inner = range(first, yes[-1] + 1)
    return " ".join(lines[i][0] for i in inner if not lines[i][2] and (chosen[i] or 2 * lines[i][5] <= len(lines[i][0])))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; nothing is shuffled, rows stay as they are (repeats too).

    A null or empty html, or one without content, gives an empty text. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
