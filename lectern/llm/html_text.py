"""HTML extraction (8): tag-path ratios.

A page becomes a sequence of text blocks, each with its root-to-leaf tag path (tags with their class, id and
role words). For every path, text length, punctuation and link text are summed over the page; a path's ratio is text a
block times its share of sentence punctuation, less its linked text. Ratios are smoothed over the
neighbouring blocks in page order and fused with the raw path ratio; blocks outside the main containers (every
article and main; if these hold little, also the smallest element with nearly all text) count with less of theirs. Blocks above a threshold are content,
wherever they stand, and so are the short blocks between them and headings on top of them; linked paths and
runs of links are not. Page furniture is left out first: by tag, role and invisibility (navigation, header, footer, aside, form, hidden), and by
class or id names (advert, comments, ...) only where the element neither holds the page's main part nor is named as content as well.

Defined cases: a null, empty or textless page gives an empty text; unclosed and stray tags close
as browsers would; rows that repeat give equal rows; an empty table gives no rows; only page_id, url, html are read.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import small_batches

_raw = frozenset("script style noscript template textarea iframe svg title select object canvas".split())  # what they hold is no text
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_attr = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(\s*=\s*)?")
_bare = re.compile(r"[^\s>]*")
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _raw}
_invisible = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_inline = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_void = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_self_closing = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_scope = frozenset("ul ol dl table article section div main body aside nav header footer form blockquote td th".split())
_furniture_tags = frozenset("nav footer aside form button menu dialog head input".split())
_stops = _scope | frozenset(_self_closing)
_furniture_words = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar aside side widget widgets "
    "comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social "
    "related recommended recommendations tags pagination pager toolbar masthead topbar search skip copyright legal disclaimer".split()
)
_content_words = frozenset("article articles body content entry main post story text prose".split())
_having = frozenset("has have with without no is".split())  # "has-sidebar" names what stands beside, not the element itself
_roles = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert form".split())
_headings = frozenset("h1 h2 h3 h4 h5 h6".split())
_rows = frozenset("li dd dt td th caption".split())
_lists = frozenset("ul ol dl table".split())
_OUTSIDE = 0.6  # share of its path ratio that a block outside the main containers counts with
_sentence = re.compile(r"[.!?…,;:]")
_space = re.compile(r"\s+")


def _words(value: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()) if w]


class Node:
    """An open element. `path` numbers its root-to-leaf tag path; `stop` is the nearest element that bounds implied end tags."""

    __slots__ = ("tag", "path", "parent", "furniture", "suspect", "in_main", "stop", "depth", "weight", "heads", "boxed")

    def __init__(self, tag: str, path: int, parent: "Node | None", furniture: bool, suspect: bool):
        self.tag, self.path, self.parent, self.furniture, self.suspect = tag, path, parent, furniture, suspect
        self.in_main = tag in ("article", "main") or (parent is not None and parent.in_main)
        self.stop = self if parent is None or tag in _stops else parent.stop
        self.depth = parent.depth + 1 if parent else 0
        self.weight, self.heads, self.boxed = 0, 0, False


def _named(tokens: list[str]) -> tuple[list[str], bool]:
    """All words of class and id names, and whether these make the element look like page furniture."""
    words, looks, content = [], False, False
    for token in tokens:
        own = _words(token)
        words += own
        if own and own[0] not in _having and not _furniture_words.isdisjoint(own):
            looks = True
        elif len(own) == 1 and own[0] in _content_words:
            content = True
    return words, looks and not content


class Page:
    """One pass over the markup, in time linear in it: a list of blocks and the elements they stand in."""

    def __init__(self, page: str):
        self.page, self.paths, self.open = page, {}, {}
        self.nodes: list[Node] = []
        self.no_more: set[str] = set()  # quotes that do not occur any further
        self.node = self.owner = self._new("", "", None, False, False)
        self.out: list[tuple[Node, str, int]] = []
        self.parts: list[str] = []
        self.linked = self.depth_a = 0
        self._run()

    def _new(self, tag: str, key: str, parent: Node | None, furniture: bool, suspect: bool) -> Node:
        path = self.paths.setdefault((parent.path if parent else -1, key), len(self.paths))
        node = Node(tag, path, parent, furniture, suspect)
        self.nodes.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1
        return node

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from here, and where the tag ends; a quote that never closes is a plain character."""
        page, out = self.page, []
        while m := _attr.match(page, at):
            name, has_value, at, value, end = m[1].lower(), m[2], m.end(), "", -1
            if has_value:
                quote = page[at : at + 1]
                if quote in ("'", '"') and quote not in self.no_more:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        self.no_more.add(quote)
                if end < 0:
                    end = _bare.match(page, at).end()
                    value, at = page[at:end], end
                else:
                    value, at = page[at + 1 : end], end + 1
            out.append((name, value))
        end = page.find(">", at)
        return out, (len(page) if end < 0 else end + 1)

    def _element(self, tag: str, attributes: list[tuple[str, str]], parent: Node) -> Node:
        names, bad = [], tag in _furniture_tags or (tag == "header" and not parent.in_main)
        for name, value in attributes:
            if name in ("class", "id"):
                names += value.split()
            elif name == "role":
                bad = bad or value.strip().lower() in _roles
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                bad = True
            elif name == "style":
                bad = bad or bool(_invisible.search(value))
        words, looks = _named(names) if names else ([], False)
        looks = looks and tag not in ("body", "html", "article", "main")
        return self._new(tag, f"{tag}.{'.'.join(sorted(set(words)))}" if words else tag, parent, bad or parent.furniture, looks)

    def _flush(self) -> None:
        if self.parts:
            text = _space.sub(" ", "".join(self.parts)).strip()
            if text:
                self.out.append((self.owner, text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def _say(self, text: str) -> None:
        text = html.unescape(text)
        self.parts.append(text)
        if self.depth_a:
            self.linked += len(text.strip())

    def _leave(self, target: Node) -> None:
        """Close elements up to and with this one."""
        while self.node is not target:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent
        self.open[target.tag] -= 1
        self.node = target.parent

    def _start(self, tag: str, attributes: list[tuple[str, str]], empty: bool) -> None:
        if tag in _self_closing:
            inner, ends = self.node.stop, _self_closing[tag]
            while inner.parent and inner.tag not in _scope and inner.tag not in ends:
                inner = inner.parent.stop
            if inner.tag in ends:
                self._leave(inner)
        elif self.node.tag == "p":
            self._leave(self.node)
        if not empty:
            self.node = self._element(tag, attributes, self.node)

    def _end(self, tag: str) -> None:
        if self.open.get(tag):  # a stray end tag closes nothing
            target = self.node
            while target.tag != tag:
                target = target.parent
            self._leave(target)

    def _inline(self, tag: str, close: bool, attributes: list[tuple[str, str]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.depth_a = max(0, self.depth_a + (-1 if close else 1))
        elif tag == "span":
            if close and self.node.tag == "span":
                self._flush()
                self._leave(self.node)
                self.owner = self.node
            elif not close and attributes and not self.node.furniture:
                inner = self._element(tag, attributes, self.node)
                if inner.furniture or inner.suspect:
                    self._flush()
                    self.node = self.owner = inner
                else:
                    self.open[tag] -= 1

    def _run(self) -> None:
        page, at, said = self.page, 0, 0
        while True:
            at = page.find("<", at)
            if at < 0:
                break
            if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
                mark = "-->" if page[at + 2] == "-" else "]]>"
                end = page.find(mark, at + 4)
                end = len(page) if end < 0 else end + 3
            elif page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at)
                end = len(page) if end < 0 else end + 1
            elif not (m := _tag.match(page, at)):
                at += 1
                continue
            else:
                end = -1
            if at > said:
                self._say(page[said:at])
            if end < 0:
                close, tag = bool(m[1]), m[2].lower()
                attributes, end = self._attributes(m.end())
                empty = tag in _void or page[end - 2 : end] == "/>"
                if tag in _raw and not close and not empty:
                    end = self._skip(tag, end)
                elif tag in _inline:
                    self._inline(tag, close, attributes)
                elif tag not in _raw:
                    self._flush()
                    self.depth_a = 0
                    if close:
                        self._end(tag)
                    else:
                        self._start(tag, attributes, empty)
                    self.owner = self.node
            at = said = end
        self._say(page[said:])
        self._flush()

    def _skip(self, tag: str, at: int) -> int:
        """Behind the end tag of an element whose content is no text; the end of the page if there is none."""
        m = _raw_end[tag].search(self.page, at)
        end = self.page.find(">", m.end()) if m else -1
        return len(self.page) if end < 0 else end + 1


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """(block element, text with collapsed white space, linked characters) in page order."""
    return Page(page).out


def content_blocks(page: Page) -> list[tuple[Node, str, int]]:
    """The blocks outside page furniture.

    Tags, roles and invisibility decide alone. A name only decides for an element that is not the page itself: one that holds
    the main container, the page's first heading of the top level, or nearly all prose with no other container outside stays.
    """
    found = [b for b in page.out if not b[0].furniture]
    for node, text, linked in found:
        node.weight += max(0, len(text) - linked)
        node.heads |= node.tag == "h1"
    for node in reversed(page.nodes):
        node.heads |= node.tag == "main"
        if node.parent:
            node.parent.weight += node.weight
            node.parent.heads |= node.heads
    total = page.nodes[0].weight
    headed = page.nodes[0].heads or any(n.tag == "article" and not n.furniture and not n.suspect for n in page.nodes)
    for node in page.nodes[1:]:
        own = node.suspect and not node.heads and (headed or node.weight < 0.8 * total)
        node.furniture = node.furniture or own or node.parent.furniture
    return [b for b in found if not b[0].furniture]


def _inside(page: Page, found: list[tuple[Node, str, int]]) -> tuple[np.ndarray, bool]:
    """Blocks in any article or main, if these hold most unlinked text (and that they do); else also in the smallest container with nearly all of it."""
    for node in page.nodes:
        node.weight = 0
    for node, text, linked in found:
        node.weight += max(0, len(text) - linked)
    for node in reversed(page.nodes[1:]):
        node.parent.weight += node.weight
    total = page.nodes[0].weight
    named = np.array([node.in_main for node, _, _ in found])
    if sum(max(0, len(text) - linked) for (_, text, linked), k in zip(found, named, strict=True) if k) >= 0.5 * total > 0:
        return named, True
    box = max((n for n in page.nodes if n.weight >= 0.8 * total and n.tag not in ("p", "h1", "h2", "h3", "span", "li", "td")), key=lambda n: n.depth, default=None)
    for node in page.nodes:
        node.boxed = node is box or (node.parent is not None and node.parent.boxed)
    return named | np.array([node.boxed for node, _, _ in found]), False


def _list_parent(node: Node) -> Node | None:
    """What holds the outermost list or table a row of one is in."""
    holder = None
    while node is not None and node.tag not in ("article", "main", "body"):
        if node.tag in _lists:
            holder = node.parent
        node = node.parent
    return holder


def main_text(page: str | None, spread: int = 2, floor: float = 0.35) -> str:
    """The article's blocks, joined by blank lines.

    Inside article or main elements that hold most of the text every block stays but linked paths and runs of links. Elsewhere the
    path ratios choose: blocks whose ratio, fused with that of `spread` blocks on each side, reaches `floor` of the greatest; with them
    what is short between them, lists and tables that stand beside them in one element, and headings on top.
    """
    whole = Page(page or "")
    found = content_blocks(whole)
    if not found:
        return ""
    paths = [node.path for node, _, _ in found]
    length, marks, links, count = (defaultdict(float) for _ in range(4))
    for path, (_, text, linked) in zip(paths, found, strict=True):
        length[path] += len(text)
        marks[path] += len(_sentence.findall(text))
        links[path] += linked
        count[path] += 1
    ratio = {p: (length[p] / count[p]) * (1 + marks[p] / count[p]) * max(0.0, 1 - 1.5 * links[p] / max(1, length[p])) for p in length}
    raw = np.log1p([ratio[p] for p in paths])
    width = 2 * spread + 1
    smooth = np.convolve(np.pad(raw, spread, mode="edge"), np.ones(width) / width, "valid")
    fused = np.maximum(raw, (raw + smooth) / 2)
    inside, certain = _inside(whole, found)
    score = np.where(inside, fused, _OUTSIDE * raw)
    linked = np.array([2 * len(text) <= 3 * links for _, text, links in found])
    beside = np.concatenate([[False], linked, [False]])
    listed = linked & (beside[:-2] | beside[2:])  # runs of links, though their path may hold prose elsewhere
    able = (raw > 0) & ~listed
    keep = able & (score >= floor * score.max())
    if not keep.any():
        return "\n\n".join(text for _, text, _ in found)
    # short blocks between content, and headings on top of it
    at = np.arange(len(found))
    before = np.maximum.accumulate(np.where(keep, at, -1))
    after = np.minimum.accumulate(np.where(keep, at, len(found))[::-1])[::-1]
    between = (before >= 0) & (after < len(found))
    same = (inside[before] == inside) | (inside[np.minimum(after, len(found) - 1)] == inside)
    out = keep | (able & between & same) | (able & inside if certain else False)
    if not certain:
        beside_kept = {id(node.parent) for (node, _, _), k in zip(found, out, strict=True) if k and node.tag not in _rows}
        for i, (node, _, _) in enumerate(found):
            if able[i] and inside[i] and node.tag in _rows and id(_list_parent(node)) in beside_kept:
                out[i] = True
    for i in range(len(found) - 2, -1, -1):
        out[i] = out[i] or (able[i] and out[i + 1] and found[i][0].tag in _headings)
    chosen = [text for (_, text, _), k in zip(found, out, strict=True) if k]
    return "\n\n".join(chosen)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(lambda page: main_text(page if isinstance(page, str) else None)).astype(object)

    return pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
