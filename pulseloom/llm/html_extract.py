"""Main text of web pages.

The standard library's parser streams a page's tags and text once. Text gathers in lines, a new one at each
block-level tag; a line knows its characters, the tags within it and the containers it stands in. The
text-to-tag ratios of the lines are smoothed with a Gaussian and split by a threshold into content and rest;
content selects the region of the page: the innermost article or main element that holds most of the content
if there is one, else from the first to the last content line. Elements that never hold an article (menus,
scripts, forms, ...) and containers whose class, id or role names what stands beside one (adverts, readers'
comments, ...) are no part of a region. Names that can also be a text's subject (notice, related, ...) count
for nothing where hardly any other text is left.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

from .common import annotate

#: Element names of HTML by what they mean here.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas audio video map menu dialog".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CENTRES = frozenset(("article", "main"))
#: Containers of which an end tag of something opened outside closes nothing, and the tags that close them nevertheless.
WALLS = frozenset("article body main td nav footer aside".split())
CROSSING = WALLS | {"html", "table", "tbody", "tr"}
#: Elements that a main or article element inside of them shows to be unclosed, or wrapped around the page.
WRAPPERS = frozenset("nav header menu form".split())
#: Words of names that mark what stands beside an article: always; where there is other text; and words
#: that may stand with them in a name.
BESIDE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus replies cookie cookies consent gdpr complementary contentinfo masthead pagination".split())
MAYBE = frozenset("notice notices promo promotion banner widget widgets respond popup modal overlay newsletter subscribe signup login share sharing social related recommended pager toolbar copyright topbar search".split())
BESIDES = frozenset("site page post posts article articles entry reader readers user main primary secondary global top bottom left right bar box list section area container wrapper wrap inner block unit slot group panel links link items item buttons icons form thread count side".split())
SUBJECTS = frozenset("article entry post page main".split())
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: Character references whose number is too long for Python's int().
FAR = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[0-9]{4000,});?")
OPENING = re.compile(r"<[a-zA-Z/!?]")
FREE, WEAK, WRAPPED, OUT = range(4)  # marks of a container


def mark_of(names: str, in_centre: bool) -> int:
    """What the class, id and role of an element say: each name counts as a whole, so with-sidebar or no-comments mark nothing."""
    found = FREE
    for name in names.split():
        words = [w.lower() for w in NAME.findall(name) if not w.isdigit()]
        if not words or words[-1] in SUBJECTS and len(words) > 1:
            continue
        if words in (["side", "bar"], ["top", "bar"]):
            words = ["".join(words)]
        beside, maybe = any(w in BESIDE for w in words), any(w in MAYBE for w in words)
        if words[-1] == "header" and not in_centre and all(w in BESIDES for w in words[:-1]):
            found = max(found, WEAK)
        elif (beside or maybe) and all(w in BESIDE or w in MAYBE or w in BESIDES for w in words):
            found = max(found, OUT if beside else WEAK)
    return found


class Lines(HTMLParser):
    """Lines of a page: [text parts, tags, mark, centre, whether it is a first-level heading].

    A page is fed whole. Comments, declarations and instructions without an end reach to the end of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = [[[], 0, FREE, 0, False]]
        self.open: list[tuple[str, int, int]] = []  # name, mark, centre
        self.where: dict[str, list[int]] = {}  # places in open by name
        self.walls: list[int] = []
        self.parent = [-1]  # of the centres

    def cut(self) -> None:
        name, mark, centre = self.open[-1] if self.open else ("", FREE, 0)
        line = [[], 0, mark, centre, name == "h1"]
        if self.lines[-1][0]:
            self.lines.append(line)
        else:
            line[1] = self.lines[-1][1]
            self.lines[-1] = line

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS or tag in NEVER
        if block and self.open and (self.open[-1][0] == "p" and tag != "br" or tag == "li" == self.open[-1][0]):
            self.close_from(len(self.open) - 1)  # a paragraph or list item ends where the next block begins
        self.lines[-1][1] += 1
        if not block and not any(k == "hidden" for k, _ in attrs):
            return
        if tag not in EMPTY:
            name, mark, centre = self.open[-1] if self.open else ("body", FREE, 0)
            if tag in CENTRES:
                if mark == WRAPPED or mark == WEAK and tag == "main":
                    mark = FREE
                if mark < OUT and centre and mark_of(" ".join(v for k, v in attrs if v and k in ("class", "id")), True) == OUT:
                    mark = OUT  # a reader's comment may be an article in the article
                if mark < OUT:
                    self.parent.append(centre)
                    centre = len(self.parent) - 1
            elif mark < OUT:
                own = FREE if tag in ("body", "html") else mark_of(" ".join(v for k, v in attrs if v and k in ("class", "id", "role")), centre > 0)
                if tag in WRAPPERS and (tag != "header" or not centre and name in ("body", "html")):
                    own = max(own, WRAPPED)
                elif tag in NEVER or any(k == "hidden" for k, _ in attrs):
                    own = OUT
                mark = max(mark, own)
            self.where.setdefault(tag, []).append(len(self.open))
            if tag in WALLS:
                self.walls.append(len(self.open))
            self.open.append((tag, mark, centre))
        if block:
            self.cut()

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            name = self.open.pop()[0]
            self.where[name].pop()
            if name in WALLS:
                self.walls.pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.lines[-1][1] += 1
        at = self.where.get(tag)
        if at and (tag in CROSSING or not self.walls or at[-1] > self.walls[-1]):
            self.close_from(at[-1])
        if tag in BLOCKS or tag in NEVER:
            self.cut()

    def handle_data(self, data):
        self.lines[-1][0].append(data)

    def after(self, mark: str, at: int) -> int:
        end = self.rawdata.find(mark, at)
        return len(self.rawdata) if end < 0 else end + len(mark)

    def parse_comment(self, i, report=True):
        if self.rawdata.startswith((">", "->"), i + 4):
            return self.after(">", i)
        return self.after("-->", i + 4)

    def parse_html_declaration(self, i):
        return self.after(">", i)  # also marked sections, which HTML doesn't know

    def parse_pi(self, i):
        return self.after(">", i)


def lines_of(html: str) -> Lines:
    html = FAR.sub("�", html)
    tail = html.rfind(">") + 1
    if cut := OPENING.search(html, tail):  # a tag that never ends
        html = html[: cut.start()]
    parser = Lines()
    parser.feed(html)
    parser.close()
    return parser


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    half = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, half, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    parser = lines_of(html)
    rows = [(" ".join("".join(t).split()), tags, mark, centre, top) for t, tags, mark, centre, top in parser.lines]
    rows = [r for r in rows if r[0]]
    if not rows:
        return ""
    size, mark, at = np.array([len(r[0]) for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    free = mark == FREE
    if not (free & (at > 0)).any() and 10 * size[free].sum() < size[mark == WEAK].sum():
        free = mark <= WEAK
    if not free.any():
        return ""
    if 10 * size[free & (at > 0)].sum() >= size[free].sum():  # an article element is content unless its text is nothing beside the rest
        candidates = free & (at > 0)
    else:
        candidates = free
    smooth = smoothed(np.where(candidates, size / np.maximum(1, [r[1] for r in rows]), 0.0))
    content = candidates & (smooth >= min(smooth.std(), smooth[candidates].max()))
    n = len(parser.parent)
    own = np.bincount(at[content], size[content], n)
    inside = own.tolist()
    for c in range(n - 1, 0, -1):  # a centre comes after the one around it
        inside[max(0, parser.parent[c])] += inside[c]
    best = max((c for c in range(1, n) if 2 * inside[c] >= size[content].sum()), default=0)
    if best:
        chosen = np.zeros(n, bool)
        chosen[best] = True
        for c in range(best + 1, n):
            chosen[c] = chosen[parser.parent[c]]
        region = chosen[at]
        if not any(r[4] for r, x in zip(rows, region & free, strict=True) if x) and parser.parent[best]:
            region = region | np.array([r[4] and r[3] == parser.parent[best] for r in rows])  # the headline stands before the article
    elif any(inside[1:]):
        region = at > 0
    else:
        found = np.flatnonzero(content)
        region = np.zeros(len(rows), bool)
        region[found[0] : found[-1] + 1] = True
        if before := np.flatnonzero(free[: found[0]]).tolist():
            region[before[-1]] = rows[before[-1]][4]  # a headline right before it
    return " ".join(r[0] for r, keep in zip(rows, region & free, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text (the page's main text) and n_chars (its code points) in place of the html.

    A null or empty page, or one without main text, gives an empty text. Columns other than the html pass
    through; those named like a result are replaced.
    """

    def run():
        def work(texts):
            made = [main_text(x) for x in texts]
            return [made, [len(x) for x in made]]

        return work

    return annotate(pages, run, "text string, n_chars long", html, drop=(html,))
