"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser turns a page into lines, one per block of text, each with the number of its
characters and tags; what HTML itself says is no text of an article (scripts, menus, forms, the page's header and footer)
gives none. The ratios are smoothed with a Gaussian and split in two clusters by a threshold found by two-means. The lines
above it choose the content region: the article or main element that holds most of their text, else the innermost
container that holds nearly all of it. What stands in the region belongs to it, so that short lines between and behind
long ones stay; names of classes only take adverts, comments and the like out of it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import pieces

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head script style noscript template nav footer aside form button select option textarea svg canvas iframe object audio video map dialog menu title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a block's start or an end tag left out may close along with a paragraph.
INLINE = frozenset("a abbr b bdi bdo cite code del em font i ins kbd mark q s samp small span strong sub sup time u var".split())
CONTAINER = frozenset("article main section div td table ul ol dl body blockquote".split())
#: What stands in one of these belongs to it, whatever containers it holds; the header in one is its own.
WHOLE = frozenset(("article", "main"))
#: Elements whose class names speak of the page rather than of themselves, and that no one text fills alone.
PAGE = frozenset(("", "html", "body"))
# Words of names of what isn't the article's; those of ASIDE are so within an article too. PLAIN ones say nothing by themselves.
ASIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal overlay sidebar comment comments disqus respond related recommended share sharing social newsletter subscribe signup pagination pager".split())
NOISE = ASIDE | frozenset("banner banners notice notices alert menu nav navbar navigation breadcrumb breadcrumbs footer header masthead reply replies login search widget toolbar skip tags".split())
PLAIN = frozenset("site page global top bottom left right main box wrap wrapper container area block section list item items inner outer bar link links slot unit posts form group row col".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
SPACES = re.compile(r"\s+")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
#: Shares of the seeds' text that an article or main element, and any other container, must hold to be the region; of links that make a list a menu.
MOST, NEARLY_ALL, LINKED = 0.5, 0.8, 2 / 3


class Lines(HTMLParser):
    """Collects lines outside noise: text, tags, characters in links and the element they stand in; and the tree of elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.name = [0], [""]
        self.stack: list[tuple[str, bool, int, bool]] = [("", False, 0, False)]  # element, noise, number, in an article
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self):
        text = SPACES.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][2]))
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
            self.leave("p", INLINE)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.leave(tag, INLINE)
        if tag in VOID:
            self.tags += not self.stack[-1][1]
            self.text.append(" " * (tag == "br"))
            return
        _, noise, number, whole = self.stack[-1]
        noise = noise or tag in DROP or tag == "header" and not whole or tag not in PAGE and tag not in WHOLE and named_noise(attrs, whole)
        self.tags += not noise
        self.links += tag == "a"
        if tag in BLOCK:
            self.parent.append(number)
            self.name.append(tag)
            number = len(self.name) - 1
        self.stack.append((tag, noise, number, whole or tag in WHOLE))

    def cut(self, i):
        self.links -= sum(x[0] == "a" for x in self.stack[i:])
        del self.stack[i:]

    def leave(self, tag, through):
        """Leave the innermost open `tag` if only elements of `through` stand above it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                return
            if self.stack[i][0] not in through:
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += not self.stack[-1][1]
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                return
            if self.stack[i][0] in BLOCK and tag not in BLOCK:
                return  # a stray end tag

    def handle_data(self, data):
        if not self.stack[-1][1]:
            self.text.append(data)
            self.linked += len(data) if self.links else 0


def named_noise(attrs, whole: bool) -> bool:
    """Whether a class, an id or a role says that an element isn't the article's: a name all of whose words are known, one of them as noise."""
    words = ASIDE if whole else NOISE
    for k, v in attrs:
        if v and k in ("class", "id"):
            for name in v.split():
                parts = [w.lower() for w in NAME_PARTS.findall(name)]
                if any(w in words for w in parts) and all(w in NOISE or w in PLAIN for w in parts):
                    return True
        if v and k == "role" and v.strip().lower() in NOISE_ROLES and not (whole and v.strip().lower() == "banner") or k == "hidden" or k == "aria-hidden" and v == "true":
            return True
    return False


def region(page: Lines, seeds: np.ndarray) -> tuple[int, list[int]]:
    """The element that the lines of `seeds` choose, and the characters of seeds in each element."""
    held = [0] * len(page.name)
    for (text, _, _, at), seed in zip(page.lines, seeds.tolist(), strict=True):
        held[at] += len(text) if seed else 0
    for i in range(len(held) - 1, 0, -1):  # elements stand behind those that hold them
        held[page.parent[i]] += held[i]
    for i in range(len(held) - 1, 0, -1):
        if page.name[i] in WHOLE and held[i] >= MOST * held[0]:
            return i, held
    below: dict[int, list[int]] = {}
    for i in range(1, len(held)):
        below.setdefault(page.parent[i], []).append(i)
    at = 0
    while inner := [i for i in below.get(at, ()) if held[i] >= NEARLY_ALL * held[0] and (page.name[i] in CONTAINER or page.name[i] in PAGE)]:
        at = inner[0]
    return at, held


def content(page: Lines, seeds: np.ndarray) -> list[str]:
    """The lines of the region that seeds choose.

    In an article or main element all of them; in another one, not those of inner containers without a seed that are menus,
    nor, where the region is the page itself, those of any inner container without a seed.
    """
    chosen, held = region(page, seeds)
    links, size = [0] * len(held), [0] * len(held)
    for text, _, linked, at in page.lines:
        links[at] += linked
        size[at] += len(text)
    for i in range(len(held) - 1, 0, -1):
        links[page.parent[i]] += links[i]
        size[page.parent[i]] += size[i]
    inside = [False] * len(held)  # the state of an element is that of the one that holds it, unless it begins something
    inside[chosen] = True
    whole, alone = page.name[chosen] in WHOLE, page.name[chosen] in PAGE
    for i in range(chosen + 1, len(held)):
        inside[i] = inside[page.parent[i]]
        if inside[i] and not whole and not held[i] and page.name[i] in CONTAINER:
            inside[i] = not alone and links[i] < LINKED * size[i]
    return [text for text, _, _, at in page.lines if inside[at]]


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, each value weighted by what of the window lies inside."""
    reach = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if len(x) < len(k):  # keep the values' places when the window is the longer one
        x, n = np.pad(x, (0, len(k) - len(x))), len(x)
    else:
        n = len(x)
    ones = np.zeros(len(x))
    ones[:n] = 1
    return np.convolve(x, k, "same")[:n] / np.convolve(ones, k, "same")[:n]


def threshold(x: np.ndarray) -> float:
    """The border of two clusters of values, by two-means from the extremes; their minimum if all are alike."""
    low, high = float(x.min()), float(x.max())
    if high <= low * 1.5:
        return low
    for _ in range(32):
        cut = (low + high) / 2
        a, b = x[x < cut], x[x >= cut]
        if not len(a) or not len(b) or (a.mean(), b.mean()) == (low, high):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def extract(page: str | None, sigma: float = 1.0) -> str:
    """The main text: blocks in page order joined by an empty line; empty if the page has none."""
    if not page:
        return ""
    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    ratio = smooth(np.array([len(line[0]) / max(1, line[1]) for line in parser.lines], float), sigma)
    return "\n\n".join(content(parser, ratio >= threshold(ratio)))


def main_text(pages: DataFrame, *, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page's main text.

    Null or empty html and pages of noise alone give an empty text. White space within a block becomes one space;
    nothing else is cut, whatever the length. Rows are independent: repeated rows repeat, an empty table gives none.
    """
    fields = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches):
        for piece in pieces(batches, "html"):
            text = [extract(bytes(h.as_py()).decode("utf-8", "replace"), sigma) for h in piece["html"]]
            yield pa.RecordBatch.from_arrays([piece["page_id"], piece["url"], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).mapInArrow(run, fields)
