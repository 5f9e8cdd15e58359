"""Main text of web pages by text-to-tag ratios of lines.

The standard library's parser streams events; text between block tags is a line. A
line's ratio is its characters to the tags since the line before; ratios are smoothed by
a Gaussian over neighbouring lines, and runs of lines above a threshold are content.
The element that holds most of the content is the article: all its lines are its text,
short ones too, but for those inside menus, headers, adverts, forms and the like. Tags
and roles say what these are. A class or id only makes it likely: a part named so
counts for nothing at first, and is taken back if it turns out to hold the content.

All is linear in a page's length, however its tags are nested or left open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import blocks, ready

#: Width of the Gaussian in lines, and its reach.
SIGMA, REACH = 1.0, 3
#: The threshold is so many standard deviations of the smoothed ratios.
DEVIATIONS = 0.5
#: A part of an element is entered if it holds this share of the element's content.
SHARE = 0.6
#: A part set apart by its name alone is taken back if the content outside is less than this share of its own.
OUTSIDE = 0.2

# HTML's element names, and words by which pages name what is no article.
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template title head svg annotation annotation-xml iframe object canvas audio video select textarea button datalist".split())
_APART = frozenset("nav footer aside form menu dialog search".split())
_HOLDERS = frozenset("html body article main section div td center blockquote header".split())
_HEADINGS = frozenset("h1 h2 h3".split())
#: Within these an open element is looked for, not beyond.
_BOUNDS = _HOLDERS | frozenset("ul ol table dl".split())
#: An open element of these ends where one of the same kind, or the second kind, begins.
_ENDS = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot adunit alert banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie"
    " cookies discussion disqus feedback footer gdpr header login masthead menu menus modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination popup"
    " promo promos promotion recommended related replies reply respond responses search share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subnav subscribe"
    " subscription toast toolbar topbar topnav widget widgets".split()
)
#: Those of them that say so even as a part of a longer name, however much the element holds.
_SURE = frozenset(
    "adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr masthead navbar navigation navlinks newsletter replies reply respond"
    " responses sidebar sidebars sidenav signup subnav topnav".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())
#: A class or id that is one of these says that an element is the article, or in it; words of a longer name then count for nothing.
_OWN = frozenset("article entry post story content".split())
#: Words that say nothing beside others.
_PLAIN = frozenset("area bar block box container inner item items link links list outer panel row section wrap wrapper".split())
#: With these, a name says what a page has beside the element.
_BESIDE = frozenset("has with without no".split())
#: Generated names: a post's terms, a builder's containers, switches of a page.
_GENERATED = re.compile(r"(?:category|tag)[-_].*|.*[-_](?:widget[-_](?:container|wrap)|enabled|disabled)|content[-_]widget", re.IGNORECASE)
#: Names of lists of remarks, of elements that say who wrote one and when, and what a line of that kind has.
_THREADS = frozenset("thread threads remarks reactions opinions".split())
_BYLINES = frozenset("author avatar byline commenter date time timestamp user username".split())
_BY = re.compile(r"\b(?:says|said|wrote|writes|replied|reply|posted|commented|answered|ago)\b|\b\d{1,2}:\d{2}\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b", re.IGNORECASE)
_FORMS, _SIGNED, _NAMING = frozenset("form textarea input".split()), frozenset("time cite".split()), frozenset("class id rel itemprop".split())
#: Characters of such a line at most.
BYLINE = 80
#: A part inside an article whose name has one of the words goes if so much of it is links.
LINKS = 0.5
_CUT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?\s*>)", re.DOTALL)
_TAG = re.compile(r"<([A-Za-z][^\s/>]*)")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: What a name says of an element: nothing, that it may be apart as a part of a longer name has it, or that it is.
NOTHING, PERHAPS, SURE = 0, 1, 2


@lru_cache(maxsize=4096)
def _named_apart(name: str) -> int:
    """Whether a class or id says that an element is no part of an article."""
    some, found = name.split(), NOTHING
    own = any(one.lower() in _OWN for one in some)
    for one in some:
        if _GENERATED.fullmatch(one):
            continue
        words = {w.lower() for w in _CUT.split(one) if w}
        apart = words & _WORDS
        if not apart or words & _BESIDE or apart == {"header"} and words & _OWN:
            continue
        if words <= _WORDS | _PLAIN or not own and apart & _SURE:
            return SURE
        if not own:
            found = PERHAPS
    return found


@lru_cache(maxsize=4096)
def _says(name: str) -> tuple[bool, bool]:
    """Whether a name says that an element is the article, and whether it says who wrote something."""
    lower = name.lower()
    return not _OWN.isdisjoint(lower.split()), not _BYLINES.isdisjoint(_CUT.split(lower))


#: Set apart by a form alone.
FORM = 2


class _Open(NamedTuple):
    """An open element: its name, the holder it is in, whether it is set apart by tag or role, unseen, by which name, inside a link, inside an article, its bound's count of open names, whether it is in a header, and its outermost list and the item of that."""

    tag: str
    holder: int
    apart: int
    unseen: bool
    named: int
    linked: bool
    inside: bool
    counts: dict[str, int]
    header: bool
    list: int
    item: int


class _Line(NamedTuple):
    """A line: its text, tags before and in it, its holder, whether it is set apart by tag or role, by which name, whether it is a heading, whether all of it is links, whether it is in a header, its list and item, and whether an element in it says who wrote it."""

    text: str
    tags: int
    holder: int
    apart: bool
    named: int
    heading: bool
    linked: bool
    header: bool
    list: int
    item: int
    signed: bool


class _Lines(HTMLParser):
    """Lines of a page, the elements that hold them, and the parts that are named apart."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # holders in the order they begin, so that parents come first: each one's parent and kind
        self.parents, self.kinds = [-1], ["html"]
        # parts that are named apart, likewise; the first stands for none
        self.outer, self.sure = [-1], [False]
        # of these: whether they are inside an article, the words of their names, whether there are forms in them
        self.within, self.words, self.forms = [False], [frozenset()], [False]
        self.lists, self.items = [""], 0  # names of outermost lists; items of all of them
        self.open = [_Open("", 0, 0, False, 0, False, False, {}, False, 0, 0)]
        self.all: dict[str, int] = {}
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags, self.heading, self.free, self.signed = 0, False, False, False

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                e = self.open[-1]
                self.lines.append(_Line(text, max(self.tags, 1), e.holder, bool(e.apart), e.named, self.heading, not self.free, e.header, e.list, e.item, self.signed))
                self.tags, self.heading, self.signed = 0, False, False
            self.parts, self.free = [], False

    def _pop(self, depth: int) -> None:
        for e in self.open[depth:]:
            self.all[e.tag] -= 1
        for e in self.open[depth:]:
            if e.tag not in _BOUNDS:
                e.counts[e.tag] -= 1
        del self.open[depth:]

    def _push(self, e: _Open) -> None:
        self.all[e.tag] = self.all.get(e.tag, 0) + 1
        if e.tag not in _BOUNDS:
            e.counts[e.tag] = e.counts.get(e.tag, 0) + 1
        self.open.append(e)

    def _close_open(self, *tags: str) -> None:
        """Ends the innermost open element of these names, if there is one within the bound."""
        counts = self.open[-1].counts
        if any(counts.get(t) or t in _BOUNDS and self.open[-1].tag == t for t in tags):
            depth = len(self.open) - 1
            while self.open[depth].tag not in tags:
                depth -= 1
            self._pop(depth)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._end_line()
            if other := _ENDS.get(tag):
                self._close_open(tag, other)
        self.tags += 1
        if tag in _HEADINGS:
            self.heading = True
        if tag in _FORMS:
            self.forms[self.open[-1].named] = True
        own = False
        if attrs or tag in _SIGNED:
            self.signed |= tag in _SIGNED
            for key, value in attrs:
                if value and key in _NAMING:
                    is_own, by = _says(value)
                    own |= is_own and key in ("class", "id")
                    self.signed |= by
        if tag in _VOID:
            return
        _, holder, apart, unseen, named, linked, inside, counts, header, list_, item = self.open[-1]
        unseen = unseen or tag in _UNSEEN
        if tag in ("article", "main") and apart == FORM:
            apart = 0  # a form around the whole page
        apart = apart or (FORM if tag == "form" else int(tag in _APART))
        name = NOTHING
        if attrs and not (unseen or apart == 1):
            for key, value in attrs:
                if key in ("class", "id") and value and tag not in ("html", "body", "article", "main"):
                    name = max(name, _named_apart(value))
                elif key == "role" and value and value.lower() in _ROLES:
                    apart = 1
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and value and _HIDDEN.search(value):
                    unseen = True
        if name == PERHAPS and own:
            name = NOTHING  # the class says what the id leaves open, or the other way round
        if tag == "header" and not inside:
            header = True  # the page's, unless it turns out to be in the article, whose title it holds then
        if name:
            self.outer.append(named)
            self.sure.append(name == SURE)
            self.within.append(inside)
            self.words.append(frozenset(w.lower() for k, v in attrs if k in ("class", "id") and v for w in _CUT.split(v) if w))
            self.forms.append(False)
            named = len(self.outer) - 1
        if tag in ("ol", "ul", "dl") and not list_:
            self.lists.append(" ".join(v.lower() for k, v in attrs if k in ("class", "id") and v))
            list_ = len(self.lists) - 1
        elif tag in ("li", "dt") and list_ and not item:
            self.items += 1
            item = self.items
        if tag in _HOLDERS:
            kind = "main" if attrs and any(k == "role" and v == "main" for k, v in attrs) else tag
            self.parents.append(holder)
            self.kinds.append(kind)
            holder = len(self.kinds) - 1
            inside = inside or kind in ("article", "main") or own and not name
        if tag in _BOUNDS:
            counts = {}
        self._push(_Open(tag, holder, apart, unseen, named, linked or tag == "a", inside, counts, header, list_, item))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # HTML knows no empty elements but the void ones, and drawings and the like
        if tag in _UNSEEN:
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end_line()
        self.tags += 1
        # an end tag without its start ends nothing, and none ends an element that is larger
        if tag not in _BOUNDS and tag not in _APART:
            self._close_open(tag)
        elif self.all.get(tag):
            depth = len(self.open) - 1
            while self.open[depth].tag != tag:
                depth -= 1
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        e = self.open[-1]
        if not e.unseen:
            self.parts.append(data)
            if not e.linked and not data.isspace() and any(c.isalnum() for c in data):
                self.free = True

    # of what is between < and > without being a tag the library takes some for errors, or for text

    def parse_comment(self, i: int, report: bool = True) -> int:
        found = _COMMENT.match(self.rawdata, i)
        return found.end() if found else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        end = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        at = self.rawdata.find(end, i)
        return at + len(end) if at >= 0 else -1

    def close(self) -> None:
        # what the library waits for at a page's end is no text: markup without an end, which goes, as browsers
        # have it, or a tag that is not well formed, which stands as one without attributes
        if self.rawdata.startswith("</") and not self.cdata_elem:
            self.rawdata = ""
        while self.rawdata[:1] == "<" and self.rawdata[1:2].strip("/") and not self.cdata_elem:
            rest, tag = self.rawdata, _TAG.match(self.rawdata)
            at = rest.find(">") if tag else -1
            self.rawdata = ""
            if at >= 0:
                self.handle_starttag(tag[1].lower(), [])
                if tag[1].lower() in self.CDATA_CONTENT_ELEMENTS:
                    self.set_cdata_mode(tag[1].lower())
                self.feed(rest[at + 1 :])
                if self.rawdata.startswith("</") and not self.cdata_elem:
                    self.rawdata = ""
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian means of each value and its neighbours; at the ends, of those that there are."""
    k = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    n = len(ratios)
    return np.convolve(ratios, k)[REACH : REACH + n] / np.convolve(np.ones(n), k)[REACH : REACH + n]


def _content(lines: list[_Line], counted: list[bool]) -> list[bool]:
    """Which lines are content: above the threshold of the smoothed ratios of those that count."""
    ratio = smoothed(np.array([len(x.text) / x.tags if c else 0.0 for x, c in zip(lines, counted, strict=True)]))
    return ((ratio >= DEVIATIONS * ratio.std()) & np.array(counted)).tolist()


def _kept_inside(parser: _Lines) -> list[bool]:
    """For each part inside an article that is named apart, whether it stays.

    A name of which only a part says so is that of a subject as often as not: the part goes if
    it is links or has a form. A name that says so as a whole counts, unless the part has
    a heading of the same words, as manuals name their sections, and holds neither forms
    nor further parts named so, as lists of comments do.
    """
    lines, outer, sure, within, words = parser.lines, parser.outer, parser.sure, parser.within, parser.words
    n = len(outer)
    size, linked, forms, parts, heads = [0] * n, [0] * n, list(parser.forms), [False] * n, [None] * n
    for x in lines:
        size[x.named] += len(x.text)
        linked[x.named] += len(x.text) if x.linked else 0
        if x.heading and heads[x.named] is None:
            heads[x.named] = {w.lower() for w in _CUT.split(x.text) if w}
    for k in range(n - 1, 0, -1):
        size[outer[k]] += size[k]
        linked[outer[k]] += linked[k]
        forms[outer[k]] |= forms[k]
        parts[outer[k]] |= parts[k] or bool(words[k] & _SURE)
    headed = [h is not None and w <= h | _PLAIN and bool(w & h) for h, w in zip(heads, words, strict=True)]
    return [w and not f and (h and not p if s else l < LINKS * z) for w, f, h, p, s, l, z in zip(within, forms, headed, parts, sure, linked, size, strict=True)]


def _named_content(parser: _Lines) -> list[bool]:
    """For each part that is named apart, whether it is taken back: it and what is around it hold the content all the same."""
    lines, outer, sure, within = parser.lines, parser.outer, parser.sure, parser.within
    back, stays = [True] + [False] * (len(outer) - 1), _kept_inside(parser)
    # a part inside an article counts as what is around it, or not at all
    at_part = [0] * len(outer)
    for n in range(1, len(outer)):
        at_part[n] = n if not within[n] else at_part[outer[n]] if stays[n] and at_part[outer[n]] >= 0 else -1
    if len(outer) > 1 and not all(sure[1:]):
        content = _content(lines, [not (x.apart or x.header) and at_part[x.named] >= 0 for x in lines])
        own = [0] * len(outer)
        for x, c in zip(lines, content, strict=True):
            if c:
                own[at_part[x.named]] += len(x.text)
        # with what is in its parts that are named in part, too
        weight, inner = own[:], [0] * len(outer)
        for n in range(len(outer) - 1, 0, -1):
            if not sure[n] and not within[n]:
                weight[outer[n]] += weight[n] if outer[n] else 0
                if not inner[outer[n]] or weight[n] > weight[inner[outer[n]]]:
                    inner[outer[n]] = n
        at, outside = inner[0], own[0]
        while at and outside < OUTSIDE * weight[at]:
            back[at], outside = True, outside + own[at]
            at = inner[at]
    for n in range(1, len(outer)):  # what is around comes first
        back[n] = (back[n] or stays[n]) and back[outer[n]]
    return back


def _without_remarks(lines: list[_Line], kept: list[int], content: list[bool], lists: list[str]) -> list[int]:
    """The kept lines without lists of readers' remarks at their end, and what heads them.

    Such a list comes after the article's content and has several items of more than a
    line, of which half at least say who wrote them and when; a list named so has several items.
    """
    while kept and (at := lines[kept[-1]].list):
        first = len(kept)
        while first and lines[kept[first - 1]].list == at:
            first -= 1
        items: dict[int, list[_Line]] = {}
        for i in kept[first:]:
            items.setdefault(lines[i].item, []).append(lines[i])
        told = [any(len(x.text) <= BYLINE and (x.signed or _BY.search(x.text)) for x in some) for some in items.values()]
        named = not _THREADS.isdisjoint(_CUT.split(lists[at]))
        if len(items) < 2 or not any(content[i] for i in kept[:first]) or not (named or 2 * sum(told) >= len(told) and all(len(x) > 1 for x in items.values())):
            break
        while first and lines[kept[first - 1]].heading:
            first -= 1
        kept = kept[:first]
    return kept


def main_text(html: str) -> str:
    """The article of a page, its blocks joined by line ends; '' if there is none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines, parents, kinds = parser.lines, parser.parents, parser.kinds
    back = _named_content(parser)
    counted = [not (x.apart or x.header) and back[x.named] for x in lines]
    if not any(counted):
        return ""
    content = _content(lines, counted)
    # of each element and all in it: characters of content, and lines that are content or a heading; and its own headings
    n = len(kinds)
    weight, lead, headings, last = [0] * n, [0] * n, [False] * n, list(range(n))
    for x, count, take in zip(lines, counted, content, strict=True):
        if count:
            weight[x.holder] += len(x.text) if take else 0
            lead[x.holder] += take or x.heading
            headings[x.holder] |= x.heading
    best, articles = [-1] * n, [False] * n
    for h in range(n - 1, 0, -1):
        p = parents[h]
        weight[p] += weight[h]
        lead[p] += lead[h]
        last[p] = max(last[p], last[h])
        if weight[h]:
            articles[p] |= kinds[h] == "article"
            if best[p] < 0 or weight[h] >= weight[best[p]]:
                best[p] = h
    at = 0
    while kinds[at] not in ("article", "main") or articles[at]:
        inner = best[at]
        # an element with a heading of its own is not left for a part without it
        if inner < 0 or weight[inner] < SHARE * weight[at] or headings[at]:
            break
        # nor is an element left for a part that does not have its content and headings
        if kinds[inner] not in ("article", "main") and lead[inner] < lead[at]:
            break
        at = inner
    # a header inside the element is its own
    whole = kinds[at] in ("html", "body")
    kept = [i for i, (x, count) in enumerate(zip(lines, counted, strict=True)) if (count or x.header and not (x.apart or whole) and back[x.named]) and at <= x.holder <= last[at]]
    if kinds[at] not in ("article", "main"):
        # rows of links before and after what is content or a heading are menus
        lead_lines = [i for i in kept if content[i] and not lines[i].linked or lines[i].heading]
        if lead_lines:
            kept = [i for i in kept if lead_lines[0] <= i <= lead_lines[-1] or not lines[i].linked]
    return "\n".join(lines[i].text for i in _without_remarks(lines, kept, content, parser.lists))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of pages: key, url, text, n_chars (code points).

    Whole pages are read; a null page is empty, and a page without an article has the
    text ''. Character references are decoded, white space inside a block is one space,
    and blocks are joined by one line end in page order. Broken markup is never an error:
    comments, tags and declarations that do not end go up to the page's end. Formulas'
    signs are text. Repeated
    rows get equal results each; other columns are neither read nor returned. No rows give none.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html"):
            texts = [main_text(x) if x else "" for x in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("key"), block.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    schema = T.StructType([rows.schema["key"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(each, schema).withColumnsRenamed({"key": key, "url": url} if url != "key" else {"key": key})
