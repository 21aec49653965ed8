"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, clustering."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_iter_udf

#: Elements that begin and end a line; elements without content; elements that hold no article text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head script style noscript template svg math iframe object canvas select option button textarea title datalist audio video".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
REGIONS = frozenset("article main section div body td".split())
MARKED = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent notice notification popup modal overlay comment comments discussion disqus replies reply share sharing social related recommended newsletter subscribe signup login footer masthead widget toolbar pagination pager anzeige werbung kommentar kommentare fusszeile seitenleiste publicite commentaire commentaires publicidad anuncio anuncios comentario comentarios".split())
IMPLIED = frozenset("p li td th tr dt dd option".split())
WALLS = frozenset("article main body nav table".split())
OUTER = frozenset("article main body html".split())
#: A start tag with its quoted values; one up to the first >; and how often the first may fail on a page.
TAG = re.compile(r"""<[a-zA-Z](?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+')|=)*+>""")
SHORT_TAG = re.compile(r"<[a-zA-Z][^>]*+>")
FAILURES = 16
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
#: Lines over which ratios are smoothed, share of the mass that a region must hold.
SIGMA, SHARE = 1.0, 0.8


def marked(attrs: dict) -> bool:
    """Whether an element's class, id or role names boilerplate, or it is hidden."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''} {attrs.get('role') or ''}".lower()
    return bool(names.strip()) and not MARKED.isdisjoint(re.split(r"[^a-z0-9]+", names))


@dataclass
class Line:
    region: int  # the innermost open region
    text: list[str] = field(default_factory=list)
    aside: list[str] = field(default_factory=list)  # text inside boilerplate elements
    linked: int = 0  # characters inside links
    tags: int = 1

    def read(self) -> tuple[str, bool]:
        """Its text, and whether all of it is boilerplate; boilerplate within other text is left out."""
        for parts, out in ((self.text, False), (self.aside, True)):
            t = SPACE.sub(" ", "".join(parts)).strip(" ")
            if t:
                return t, out
        return "", True


class Lines(HTMLParser):
    """Streams parser events into lines, one per block, each with the region that holds it.

    Regions know their parent, and open elements are found by name, so that work grows with the page, however
    deep it nests."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, starts boilerplate, holds no text, region around it
        self.places: dict[str, list[int]] = {}  # where elements of a name are open
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.parent, self.kinds, self.region = [-1], [""], 0  # region 0 is the page
        self.floor = 0  # open elements below it start no boilerplate any more
        self.current: Line | None = None
        self.pending = 0
        self.bad = self.never = self.inside = self.links = 0  # open elements of these sorts

    def _line(self) -> Line:
        if self.current is None:
            self.current = Line(self.region, tags=1 + self.pending)
            self.pending = 0
            self.lines.append(self.current)
        return self.current

    def _tag(self):
        if self.current is not None:
            self.current.tags += 1
        else:
            self.pending += 1

    def handle_starttag(self, tag, attrs):
        self._tag()
        if tag in BLOCKS:
            self.current = None
        if tag == "br" and self.current is not None:
            self.current.text.append(" ")
        if tag in VOID:
            return
        if tag in IMPLIED and self.places.get(tag) and self.places[tag][-1] >= (self.blocks[-1] if self.blocks else -1):
            self._pop(self.places[tag][-1])  # a new p, li or cell ends an open one that no other block has been opened in
        bad = tag in ASIDE or (tag == "header" and not self.inside) or (bool(attrs) and marked(dict(attrs)))
        if tag in ("article", "main") and not bad:  # an element left open before it doesn't hold it
            self.floor, self.bad = len(self.open), 0
        here = len(self.open)
        self.open.append((tag, bad, tag in NEVER, self.region))
        self.places.setdefault(tag, []).append(here)
        if tag in BLOCKS:
            self.blocks.append(here)
        if tag in WALLS:
            self.walls.append(here)
        self._count(here, 1)
        if tag in REGIONS:
            self.parent.append(self.region)
            self.kinds.append(tag)
            self.region = len(self.kinds) - 1

    handle_startendtag = handle_starttag

    def _count(self, k: int, by: int):
        tag, bad, never, _ = self.open[k]
        self.bad += by * (bad and k >= self.floor)
        self.never += by * never
        self.inside += by * (tag in ("article", "main"))
        self.links += by * (tag == "a")

    def _pop(self, k: int):
        while len(self.open) > k:
            last = len(self.open) - 1
            self._count(last, -1)
            tag, _, _, self.region = self.open.pop()
            for places in (self.places[tag], self.blocks, self.walls):
                if places and places[-1] == last:
                    places.pop()
        self.floor = min(self.floor, len(self.open))

    def handle_endtag(self, tag):
        self._tag()
        if tag in BLOCKS:
            self.current = None
        places = self.places.get(tag)
        # a stray end tag closes nothing outside
        if places and (tag in OUTER or not self.walls or self.walls[-1] <= places[-1]):
            self._pop(places[-1])

    def handle_data(self, data):
        if self.never or (self.current is None and not data.strip()):
            return
        line = self._line()
        (line.aside if self.bad > 0 else line.text).append(data)
        if self.links:
            line.linked += len(data.strip())

    def page(self, html: str):
        """Feeds a page piece by piece, in time linear in it.

        The parser itself gets whole tags only: it looks through all of the rest for the end of each tag that has none.
        A tag ends at the first > outside quoted values; a quote that is never closed counts as a character. Where a tag
        finds no such end, its < is text; after a few of these, tags end at the first > for the rest of the page. An
        unclosed comment ends at its first >. What stands after the last > is text."""
        last, at, end, failed, whole = html.rfind(">"), 0, len(html), 0, TAG
        comments = True
        while at < end:
            lt = html.find("<", at)
            if lt < 0 or lt > last:
                break
            if lt > at:
                self._text(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if after.isascii() and after.isalpha():
                m = whole.match(html, lt)
                if m is None:
                    failed += 1
                    whole = TAG if failed < FAILURES else SHORT_TAG
                    self._text("<")
                    at = lt + 1
                    continue
                at = self._fed(html, lt, m.end())
            elif after == "/" and html[lt + 2 : lt + 3].isalpha():
                at = self._fed(html, lt, html.index(">", lt) + 1)
            elif after and after in "!?/":
                to = html.find("-->", lt + 4) if comments and html.startswith("<!--", lt) else -1
                comments = comments and (to >= 0 or not html.startswith("<!--", lt))
                at = to + 3 if to >= 0 else html.index(">", lt) + 1
            else:
                self._text("<")
                at = lt + 1
        if at < end:
            self._text(html[at:])

    def _text(self, raw: str):
        self.handle_data(unescape(raw) if "&" in raw else raw)

    def _fed(self, html: str, begin: int, end: int) -> int:
        """Gives the parser one tag, and passes over the content of an element of raw text; where to go on."""
        self.feed(html[begin:end])
        self.rawdata = ""  # what it takes for unfinished
        raw = self.cdata_elem
        if raw is None:
            return end
        self.clear_cdata_mode()
        closing = re.compile(rf"</{re.escape(raw)}(?=[\s/>])", re.IGNORECASE).search(html, end)
        return closing.start() if closing else len(html)


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), kernel / kernel.sum(), mode="valid")


#: What decided on a line: kept by its cluster, kept between or beside cluster lines, dropped by the ratio,
#: dropped as outside the region, dropped by the name of an element.
RULES = ("cluster", "beside", "ratio", "region", "name")


def decided(html: str) -> tuple[list[str], list[str], list[float]]:
    """(text, rule, smoothed ratio) of each line of a page that holds text; rules are those of RULES.

    A line's ratio is its characters outside links per tag. Ratios are smoothed over neighbouring lines by a
    Gaussian; lines over half the standard deviation form the content clusters. The content region is the
    innermost element that holds SHARE of the clusters' text, or without one the stretch from the first to
    the last cluster line. A line of it is kept if it belongs to a cluster, lies between two cluster lines, or
    has a ratio of its own (text outside links): short lines at the edges stay, lists of links go, inside an
    article too. Elements that HTML names as boilerplate, or whose class does, are left out as a help.
    """
    parser = Lines()
    parser.page(html)
    read = [(x, *x.read()) for x in parser.lines]
    ok = np.array([not out for _, t, out in read if t])
    lines = [(x, t) for x, t, _ in read if t]
    if not lines:
        return [], [], []
    size = np.array([len(t) for _, t in lines], float)
    ratio = np.maximum(size - np.array([x.linked for x, _ in lines]), 0.0) / np.array([x.tags for x, _ in lines])
    smooth = smoothed(ratio, SIGMA)
    high = smooth >= min(0.5 * smooth.std(), smooth.max())
    content = high & ok & (ratio > 0)
    rule = np.where(high & (ratio > 0), "name", "ratio").astype(object)
    if not content.any():
        content, high = ok.copy(), ok.copy()
    if content.any():
        # text of the clusters in each region, from the innermost outwards; a region comes after its parent
        mass = np.zeros(len(parser.kinds))
        np.add.at(mass, [lines[k][0].region for k in np.flatnonzero(content)], size[content])
        for r in range(len(mass) - 1, 0, -1):
            mass[parser.parent[r]] += mass[r]
        whole = [r for r in range(1, len(mass)) if mass[r] >= SHARE * size[content].sum() and parser.kinds[r] != "body"]
        region = max(whole, default=None)
        within = np.zeros(len(mass), bool)
        for r in range(1, len(mass)):
            within[r] = r == region or within[parser.parent[r]]
        at = np.flatnonzero(content)
        between = np.zeros(len(lines), bool)
        between[at[0] : at[-1] + 1] = True
        inside = between if region is None else np.array([within[x.region] for x, _ in lines])
        kept = inside & ok & (between | (ratio > 0))
        rule[kept] = "beside"
        rule[kept & high] = "cluster"
        rule[ok & ~inside & (ratio > 0)] = "region"
    return [t for _, t in lines], rule.tolist(), smooth.tolist()


def main_text(html: str) -> tuple[str, int, int]:
    """(text, lines kept, lines): the article of a page, by decided()."""
    text, rule, _ = decided(html)
    keep = [t for t, r in zip(text, rule, strict=True) if r in RULES[:2]]
    return "\n\n".join(keep), len(keep), len(text)


def _run(batches):
    for col in batches:
        done = []
        for i in range(0, len(col), 256):
            rows = [main_text(x or "") for x in col.slice(i, 256).to_pylist()]
            done.append(pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["text", "n_kept", "n_lines"]))
        yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("text", pa.string()), ("n_kept", pa.int64()), ("n_lines", pa.int64())]))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars, n_kept, n_lines.

    Null html counts as empty, and a page without content has text ''. Repeated rows give repeated
    rows; null ids and urls stay null; other columns are ignored.
    """
    out = pages.select("page_id", "url", arrow_iter_udf(_run, "text string, n_kept long, n_lines long")(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("__x"))
    return out.select("page_id", "url", F.col("__x.text").alias("text"), F.char_length("__x.text").cast("long").alias("n_chars"), F.col("__x.n_kept").alias("n_kept"), F.col("__x.n_lines").alias("n_lines"))
