"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events once; each block (a heading, paragraph, list item
and so on) becomes one line with its text and the number of tags in it. The ratio of text to tags per
line is smoothed by a Gaussian and a threshold clusters lines into content and the rest. What ratios
cannot tell apart, long adverts or short paragraphs, is told by structure first: lines inside navigation,
forms, asides and the like never count, unless such an element wraps the page's text. Then the content
found by ratios is compared: text outside articles stands against the articles (in the page, and in a main
element), and article against article. The one that holds most of it is kept whole, and all articles are kept
if none holds most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of HTML by their part in a page.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = set("script style noscript template title svg math iframe object canvas audio video select datalist".split())
ASIDE = set("nav header footer aside form menu dialog button fieldset textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {
    "p": BLOCK - {"br", "body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "tr": {"tr", "tbody", "tfoot"}, "option": {"option"},
}
_EDGE, _END = r"(?:^|[\s_-])(?:", r")(?:$|[\s_-])"
# Names that are never main text, and names that are none outside an article.
NOISE = re.compile(
    _EDGE + r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|"
    r"related|recommend\w*|comments?|commentlist|respond|replies|disqus|login|signup" + _END, re.I,
)
FRAME = re.compile(
    _EDGE + r"nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|notice|widget|search|pagination|pager|toolbar|skip" + _END, re.I
)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
CONTAINER = {"article", "main"}
PART = CONTAINER | set("body div section center td".split())


# Names that tell an article's subject, or a state or a part of the page's text, not what an element is.
SUBJECT = re.compile(r"(?:tag|category|topic|has)[_-]", re.I)
STATE = re.compile(
    r"(?:has|with|without|no|not|is)[_-]|.*[_-](?:open|opened|closed|enabled|disabled|active|allowed|on|off)$|"
    r"(?:article|post|entry|story|content)[_-]+(?:header|head|headline|title)$", re.I
)
# Elements that begin a page's text.
LANDMARK = CONTAINER | {"h1"}


class Lines(HTMLParser):
    """Collects (text, tags, holder, frame, parent) per block while the page streams by.

    ``holder`` numbers the innermost article or main element, 0 for none; ``frame`` the innermost element
    that by tag, name or role is none of the main text, 0 for none; ``parent`` the innermost part of the
    page. ``holders`` lists tag, surrounding holder and surrounding part of each holder; its first entry is
    the page. ``frames`` lists the surrounding frame of each and whether its name tells noise;
    ``landmarks`` tag and frame of the elements that begin a text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.open: list[tuple[str, bool, int, int, int]] = []  # name, hidden, frame, holder, parent
        self.text: list[str] = []
        self.tags = 0
        self.holders = [("", 0, 0)]
        self.frames = [(0, False)]
        self.landmarks: list[tuple[str, int]] = []
        self.parts = 0

    @property
    def state(self) -> tuple[bool, int, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0)

    def cut(self) -> None:
        """End the current block."""
        text = " ".join("".join(self.text).split())
        if text:
            _, frame, holder, parent = self.state
            self.lines.append((text, self.tags, holder, frame, parent))
        if text or self.tags:
            self.text, self.tags = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.cut()
            while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
                self.open.pop()
        hidden, frame, holder, parent = self.state
        self.tags += 1
        if tag in VOID:
            return
        named = dict(attrs)
        inside = tag not in ("html", "body")
        words = ""
        if inside and tag != "main":
            names = f"{named.get('class') or ''} {named.get('id') or ''}".split()
            words = " ".join(x for x in names if not (SUBJECT if tag == "article" else STATE).match(x))
        covered = "hidden" in named or (named.get("aria-hidden") or "").lower() == "true"
        hidden = hidden or tag in HIDDEN or (inside and covered)
        noise = bool(NOISE.search(words))
        role = (named.get("role") or "").lower() in ROLES
        if noise or role or (tag in ASIDE and not (tag == "header" and holder)) or (not holder and tag != "article" and FRAME.search(words)):
            self.frames.append((frame, noise))
            frame = len(self.frames) - 1
        if tag in LANDMARK and not hidden and not noise and not role:
            self.landmarks.append((tag, frame))
        if tag in CONTAINER:
            self.holders.append((tag, holder, parent))
            holder = len(self.holders) - 1
        if tag in PART:
            self.parts += 1
            parent = self.parts
        self.open.append((tag, hidden, frame, holder, parent))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # a slash means nothing in HTML
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in CONTAINER and tag not in ("body", "html"):
                return  # a stray end tag does not leave an article

    def handle_data(self, data):
        if not self.state[0]:
            self.text.append(data)


def parsed(page: str | None) -> Lines:
    """The blocks of a page in order, and its holders."""
    parser = Lines()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return parser


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The ratios under a Gaussian window; lines beyond the ends count with nothing."""
    reach = int(np.ceil(2 * sigma))
    window = np.exp(-((np.arange(-reach, reach + 1) / sigma) ** 2) / 2)
    weight = np.convolve(np.ones(len(ratios)), window, "same") if len(ratios) > 2 * reach else None
    if weight is None:
        distance = np.arange(len(ratios))[:, None] - np.arange(len(ratios))[None]
        kernel = np.exp(-((distance / sigma) ** 2) / 2)
        return kernel @ ratios / kernel.sum(axis=1)
    return np.convolve(ratios, window, "same") / weight


def wrapping(page: Lines) -> np.ndarray:
    """Which frames are main text all the same, as they stand around it?

    If every article, main element and first heading lies in frames, and more text lies in these than
    outside all frames, then they wrap the page: a form around all of it, a menu never closed. A frame
    that is noise by name is opened by a main element or a first heading only, as readers' comments may be
    articles.
    """
    free = np.zeros(len(page.frames), bool)
    free[0] = True
    if not page.landmarks or any(not frame for _, frame in page.landmarks):
        return free
    noisy, opened = [False], [False] * len(free)
    for around, noise in page.frames[1:]:  # a surrounding frame has a smaller number
        noisy.append(noise or noisy[around])
    for tag, frame in page.landmarks:
        opened[frame] |= tag != "article" or not noisy[frame]
    for f in range(len(free) - 1, 0, -1):
        opened[page.frames[f][0]] |= opened[f]
    held = np.bincount([frame for *_, frame, _ in page.lines], [len(text) for text, *_ in page.lines], len(free))
    opened = np.array(opened) | free
    return opened if held[opened].sum() > 2 * held[0] else free


def region(page: Lines, usable: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which lines lie in the region of the page that holds most of the content?"""
    holder = np.array([h for _, _, h, _, _ in page.lines])
    parent = np.array([p for *_, p in page.lines])
    length = np.where(content, [len(text) for text, *_ in page.lines], 0)
    at = np.arange(len(holder))
    # What lies in an article belongs to it, and a main element in another to that one.
    top, inner = [0], {}
    for h, (tag, around, _) in enumerate(page.holders[1:], 1):
        over = top[around]
        top.append(over if over and (tag == "main" or page.holders[over][0] == "article") else h)
        if top[h] == h:
            inner.setdefault(over, []).append(h)
    home = np.array(top)[holder]
    own = np.bincount(home, length, len(top)).astype(np.int64)
    total, first, last = own.copy(), np.full(len(top), len(home)), np.full(len(top), -1)
    np.minimum.at(first, home, at)
    np.maximum.at(last, home, at)
    for h in inner.keys() - {0}:
        total[h] += total[inner[h]].sum()
        first[h], last[h] = min(first[h], first[inner[h]].min()), max(last[h], last[inner[h]].max())

    def best(h: int) -> tuple[np.ndarray, list[int]]:
        """The own lines of a holder that belong to its text, and the holders in it that do."""
        some = [x for x in inner.get(h, []) if total[x]]
        bare = [x for x in inner.get(h, []) if not total[x]]
        held, most = total[some].sum(), max(total[some], default=0)
        found = np.flatnonzero((home == h) & content)
        if h:
            kept = np.isin(home, [h, *bare])
        elif own[h] >= most and len(found):
            # The region runs from the first to the last content line, and has all lines of the parts that hold one.
            kept = (at >= found[0]) & (at <= found[-1]) & np.isin(home, [h, *bare]) | np.isin(parent, parent[found])
        else:
            kept = np.zeros(len(home), bool)
        if own[h] < held:
            return kept, [x for x in some if 2 * total[x] > held and total[x] > own[h]] or some
        # Articles that stand in the midst of a part's text belong to it.
        begin, end = {}, {}
        for i, p in zip(found.tolist(), parent[found].tolist()):
            begin.setdefault(p, i)
            end[p] = i
        return kept, [x for x in some if begin.get(p := page.holders[x][2], len(home)) < first[x] and end[p] > last[x]]

    kept, chosen = best(0)
    for h in chosen:
        if h in inner:
            lines, articles = best(h)
            kept = kept | lines | np.isin(home, articles)
    return kept | np.isin(home, [h for h in chosen if h not in inner])


def main_text(page: str | None) -> str:
    """Main text of a page, one block per line; empty if there is none."""
    page_lines = parsed(page)
    lines = page_lines.lines
    if not lines:
        return ""
    usable = wrapping(page_lines)[[frame for *_, frame, _ in lines]]
    ratios = np.where(usable, [len(text) / max(1, tags) for text, tags, *_ in lines], 0.0)
    soft = smooth(ratios)
    if not usable.any():
        return ""
    # Ratios spread by their standard deviation; a line over it, or over the mean of a flat page, is content.
    content = usable & (soft >= min(soft.std(), soft[usable].mean()))
    kept = usable & region(page_lines, usable, content)
    return "\n".join(lines[i][0] for i in np.flatnonzero(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) per page.

    A null page counts as empty and has an empty text. Repeated rows stay rows; other columns are not
    read. Whole pages are parsed; nothing is cut off.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = [main_text(page) for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
