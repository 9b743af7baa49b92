"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultsift.llm.batches import bounded_batches, carried, free_name, made_batch, text_slices

# Element names and roles of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
#: What a start tag ends, and where the search for it stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"]))}
NOT_TEXT = frozenset((
    "nav footer aside script style noscript template title textarea select button iframe svg math canvas object audio "
    "video dialog menu xmp noembed noframes search datalist").split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar status".split())
# Words of class and id names for what surrounds an article.
SURROUNDING = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe signup login nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager sidebar aside footer masthead comment comments disqus respond replies "
    "discussion related recommended recommendations share sharing social toolbar widget skip").split())
PREFIXES = frozenset("has with no without show hide".split())

_P, _CELLS = frozenset(["p"]), frozenset(["td", "th"])
_AROUND_P = BLOCK - _P
_BEYOND_CELLS = frozenset("td th tr table tbody thead tfoot body html".split())

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^A-Za-z][^>]*+(?:>|\Z)|"""
    r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|[="'])*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME_PARTS = re.compile(r"[A-Za-z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

LINK, NOISE, NAMED, HEADER, ARTICLE, MAIN, LIST, TOP = (1 << i for i in range(8))
LINKS_OF_A_MENU, LINK_SHARE = 3, 0.9


def _named_flags(attributes: str) -> int:
    """What an element's class, id and role say about it."""
    flags = 0
    for key, value in _NAMED.findall(attributes):
        words = value.strip("\"'").split()
        if key.lower() == "role":
            role = words[0].lower() if words else ""
            flags |= NOISE if role in ROLES else MAIN if role == "main" else ARTICLE if role == "article" else 0
            continue
        for word in words:
            parts = [p.lower() for p in _NAME_PARTS.findall(word)]
            if parts and parts[0] not in PREFIXES and (parts[0] in SURROUNDING or parts[-1] in SURROUNDING):
                flags |= NAMED
    return flags


class Page:
    """The element tree of one page in page order, and its text in pieces that know element and block."""

    def __init__(self, source: str):
        self.parent, self.flags, self.end = [0], [TOP], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._many: Counter[str] = Counter()  # open elements by name
        self._block = 0
        at, size = 0, len(source)
        while at < size:
            tag = _TAG.search(source, at)
            if tag is None:
                self._text(source[at:])
                break
            if tag.start() > at:
                self._text(source[at:tag.start()])
            at = tag.end()
            if tag[2]:
                name = tag[2].lower()
                if tag[1]:
                    self._close(name)
                else:
                    self._open(name, tag[3])
                    if name in RAW:  # its content is no markup
                        stop = _RAW_ENDS[name].search(source, at)
                        at = stop.start() if stop else size
        self._pop(0)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append((self._stack[-1][1], self._block, text))

    def _pop(self, depth: int) -> None:
        for name, node in self._stack[depth:]:
            self.end[node] = len(self.parent)
            self._many[name] -= 1
        del self._stack[depth:]

    def _open(self, name: str, attributes: str) -> None:
        stack = self._stack
        if name in BLOCK:
            self._block += 1
            if name in CLOSES_P:
                self._end_open(_P, _AROUND_P)
            if name in IMPLIED:
                self._end_open(*IMPLIED[name])
        elif name == "br":
            self.pieces.append((stack[-1][1], self._block, " "))
        if name in VOID:
            return
        flags = _named_flags(attributes) if attributes else 0
        if name in NOT_TEXT:
            flags |= NOISE
        elif name in ("html", "body"):
            flags = TOP
        elif name == "a":
            flags |= LINK
        elif name == "article":
            flags |= ARTICLE
        elif name == "main":
            flags |= MAIN
        elif name == "header":
            flags |= HEADER
        elif name == "form":
            flags |= NAMED
        elif name in ("ul", "ol", "dl"):
            flags |= LIST
        node = len(self.parent)
        self.parent.append(stack[-1][1])
        self.flags.append(flags)
        self.end.append(0)
        stack.append((name, node))
        self._many[name] += 1

    def _end_open(self, names: frozenset[str], stops: frozenset[str]) -> None:
        """Ends the innermost open element of these names, unless one of `stops` lies in between."""
        if not any(self._many[name] > 0 for name in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            here = self._stack[depth][0]
            if here in names:
                self._pop(depth)
                return
            if here in stops:
                return

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._block += 1
            self._end_open(frozenset([name]), frozenset() if name in _BEYOND_CELLS else _CELLS)
        elif name not in VOID:
            self._end_open(frozenset([name]), BLOCK)


def composite_density(chars, tags, link_chars, link_tags, all_chars, all_link_chars) -> np.ndarray:
    """Characters per tag, scaled by a logarithm that falls with the share of links; 0 without text.

    C/T * log_b(C/LC * T/LT), b = ln(C/(C-LC) * LC + LB/CB * C + e), where C, T, LC, LT count an element's
    characters, tags, link characters and link tags (1 for none) and CB, LB those of the whole body.
    """
    c, t = np.maximum(chars, 1.0), np.maximum(tags, 1.0)
    lc, lt, plain = np.maximum(link_chars, 1.0), np.maximum(link_tags, 1.0), np.maximum(c - link_chars, 1.0)
    base = np.log(c / plain * lc + all_link_chars / np.maximum(all_chars, 1.0) * c + np.e)
    return np.where(chars > 0, c / t * np.log(c / lc * t / lt) / np.log(base), 0.0)


class Forest:
    """The trees of a slice of pages as arrays in page order; subtree sums are differences of running sums."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.parent) for p in pages])
        self.root = np.cumsum(sizes) - sizes
        self.page = np.repeat(np.arange(len(pages)), sizes)
        shift = self.root[self.page]
        self.parent = np.concatenate([p.parent for p in pages]) + shift
        self.end = np.concatenate([p.end for p in pages]) + shift
        self.flags = np.concatenate([p.flags for p in pages])
        self.size = len(self.parent)
        self.owner = np.array([self.root[i] + n for i, p in enumerate(pages) for n, _, _ in p.pieces], np.int64)
        self.dropped = np.zeros(self.size, bool)
        self._drop_surroundings()

    def below(self, value: np.ndarray) -> np.ndarray:
        """The sum over each element and all inside it."""
        total = np.concatenate([[0], np.cumsum(value)])
        return total[self.end] - total[np.arange(self.size)]

    def inside(self, chosen: np.ndarray, itself: bool = True) -> np.ndarray:
        """Which elements lie in a chosen one."""
        edge = np.zeros(self.size + 1, np.int64)
        nodes = np.flatnonzero(chosen)
        np.add.at(edge, nodes if itself else nodes + 1, 1)
        np.add.at(edge, self.end[nodes], -1)
        return np.cumsum(edge)[:-1] > 0

    def has(self, flag: int) -> np.ndarray:
        return (self.flags & flag > 0) & ~self.dropped

    def _drop_surroundings(self) -> None:
        self.dropped = self.inside(self.has(NOISE))
        body = self.has(ARTICLE) | self.has(MAIN)
        self.dropped |= self.inside(self.has(NAMED) & (self.below(body & ~self.has(NAMED)) == 0))
        article = self.has(ARTICLE)
        self.dropped |= self.inside(article & self.inside(article, itself=False))  # readers' comments
        kept = self.inside(self.has(ARTICLE) | self.has(MAIN))
        self.dropped |= self.inside(self.has(HEADER) & ~kept & (self.below(self.has(ARTICLE)) == 0))

    def select(self, lengths: np.ndarray) -> np.ndarray:
        """Which elements are main text, given the length of each piece.

        Densities of the children (an element's own text counts as a child) sum up to the density sum. The element
        of the greatest sum (ties: the outermost, the first) is the text; where articles (else `main`s) with text are
        marked, it is looked for in them and stands for the whole one. Elsewhere, siblings on its path to the body
        join it if they are as dense as the least dense element of that path; what lies right in the body must be as
        dense as the part of the path below the body. Lists of links are menus.
        """
        live = ~self.dropped
        own = np.bincount(self.owner, lengths, self.size) * live
        link = self.inside(self.has(LINK))
        chars, links = self.below(own), self.below(own * link)
        tags = self.below(live.astype(float)) - live
        link_tags = self.below(self.has(LINK).astype(float))
        all_chars, all_links = chars[self.root][self.page], links[self.root][self.page]
        menu = (self.has(LIST) & (link_tags >= LINKS_OF_A_MENU) & (links >= LINK_SHARE * chars)
                & (chars < all_chars))
        density = composite_density(chars, tags, links, link_tags, all_chars, all_links)
        leaf = composite_density(own, np.ones(self.size), own * link, link.astype(float), all_chars, all_links)
        child = np.arange(self.size) != self.root[self.page]
        total = leaf + np.bincount(self.parent[child], density[child], self.size)

        scope = np.zeros(self.size, bool)
        for flag in (ARTICLE, MAIN):
            marked = self.has(flag) & (chars > 0)
            free = ~np.isin(self.page, np.unique(self.page[scope]))
            scope |= self.inside(marked) & free
        marked_page = np.zeros(len(self.root), bool)
        marked_page[self.page[scope]] = True
        able = live & (chars > 0) & (scope | ~marked_page[self.page])
        best = np.full(len(self.root), -1)
        nodes = np.flatnonzero(able)
        order = nodes[np.lexsort((nodes, -total[nodes], self.page[nodes]))]
        pages, first = np.unique(self.page[order], return_index=True)
        best[pages] = order[first]

        chosen = np.zeros(self.size, bool)
        outer = best[(best >= 0) & marked_page]
        while len(outer):  # to the marked element around it
            up = self.parent[outer]
            climbs = scope[up]
            chosen[outer[~climbs]] = True
            outer = up[climbs]
        free = best[(best >= 0) & ~marked_page]
        chosen[free] = True
        whole, inner = np.full((2, len(self.root)), np.inf)  # least densities of the path, and of its part below the body
        path, at = [], free
        while len(at):
            page = self.page[at]
            whole[page] = np.minimum(whole[page], density[at])
            under = self.flags[at] & TOP == 0
            inner[page[under]] = np.minimum(inner[page[under]], density[at[under]])
            path.append(at)
            at = self.parent[at[at != self.root[page]]]
        on_path = np.zeros(self.size, bool)
        on_path[np.concatenate(path or [np.zeros(0, np.int64)])] = True
        beside = child & live & on_path[self.parent] & ~on_path & ~self.inside(chosen)
        threshold = np.where(self.flags[self.parent] & TOP > 0, inner[self.page], whole[self.page])
        chosen |= beside & (density >= threshold) & (links < LINK_SHARE * chars)
        return self.inside(chosen) & ~self.dropped & ~self.inside(menu)


def main_texts(sources: list[str]) -> list[str]:
    """The main text of each page: its blocks in page order, one a line."""
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    words = [" ".join(text.split()) for p in pages for _, _, text in p.pieces]
    kept = forest.select(np.array([len(w) for w in words], float))[forest.owner].tolist()
    out, at = [], 0
    for page in pages:
        blocks: dict[int, list[str]] = {}
        for (_, block, text), keep in zip(page.pieces, kept[at:at + len(page.pieces)], strict=True):
            if keep:
                blocks.setdefault(block, []).append(text)
        at += len(page.pieces)
        joined = (" ".join("".join(b).split()) for b in blocks.values())
        out.append("\n".join(b for b in joined if b))
    return out


def extract_text(pages: DataFrame, *, html_column: str = "html",
                 carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The carried columns, `text` and `n_chars` (its code points) for every page.

    Null and empty pages have the empty text. Broken markup never fails: open elements end where the
    standard ends them, or with the page; an open tag or comment runs to the end of the page. Elements that are no
    text (menus, asides, footers, forms, scripts, ...), articles within articles (comments) and elements
    named so by class, id or role are left out, page headers too; a named element that holds the article stays. The rest
    is judged by composite text density (`Forest.select`). White space (also that of character references, and a
    line break) inside a block becomes one blank. Pages are never cut; repeated rows stay; a carried column
    with a made name is left out; an empty table gives no rows. Row-local: no shuffle, nothing is sent.
    """
    bounded_batches(pages.sparkSession)
    made = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    kept = carried(pages, carry, made)
    names = [f.name for f in kept]
    source = free_name(pages, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, slice_ in text_slices(batch, source):
                texts = main_texts(slice_.cast(pa.large_string()).to_pylist())
                yield made_batch(rows, names, {
                    "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(*[pages[n] for n in names], pages[html_column].alias(source)).mapInArrow(
        run, T.StructType(kept + made.fields))
