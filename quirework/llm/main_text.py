"""Main text of web pages by line-block distribution.

A page's markup is stripped into lines, one for each block of text; menus, forms and other parts that aren't the article leave
empty lines. Lengths are summed over a sliding window of lines: text begins where the sums surge and ends where they dive to zero.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import begin, release

#: Lines of a window.
WINDOW = 3
#: Where no element names the article, text surges where a window holds more than this share of the page's fullest window.
SURGE_SHARE = 0.25

#: A comment's start; a whole tag, with '>' inside quoted values; or what else opens with '<'. Each part is taken for good, so a page is read once.
_MARK = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|([!?/a-zA-Z]))""")
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S+))|([^\s=/]+)""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split()
)
#: Open elements that a start tag ends where it finds them innermost.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}, "body": {"head"}}
_NEVER = set("aside button canvas dialog footer head menu nav noscript object search select svg template audio video".split())
_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_PARTS = set(
    "alert alerts aside banner branding breadcrumb breadcrumbs consent cookie cookies copyright dialog disclaimer discussion discussions disqus feedback foot form gdpr header login logo masthead menubar modal navbar navigation newsletter "
    "notice notices notification notifications pager pagination popup promo promotion rail reactions recommended related reply replies respond responses search share sharing signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
_PART_STEMS = ("comment", "advert", "sidebar", "breadcrumb")
_PART_ENDS = ("footer", "menu", "nav")
_ADS = re.compile(r"ads?(banner|block|box|container|sense|slot|space|unit|wrapper|zone)?")
_NOT_STEMS = {"commentary"}
#: A class that says what the rest of a page has, not what the element is: "with-sidebar".
_SAYS_OF_OTHERS = {"has", "with", "no", "without", "is", "not"}
_OF_THE_TEXT = {"article", "content", "entry", "post", "story"}


@dataclass(slots=True)
class _Node:
    """An open element that holds text: its parent's number, whether it isn't part of the article, and if that is only what a class or form suggests."""

    parent: int
    apart: bool
    soft: bool
    region: bool
    main: bool
    size: int = 0
    paragraphs: int = 0
    titles: int = 0


@dataclass(slots=True)
class _Line:
    text: str
    node: int
    linked: int
    title: bool
    gap: int


def _apart(tag: str, attributes: str, in_text: bool) -> tuple[bool, bool]:
    """Whether an element is no part of an article, and if only its class, id, role or being a form or header says so."""
    if tag in _NEVER:
        return True, False
    if tag == "header":
        return not in_text, True
    if tag == "form":
        return True, True
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name = (name or bare).lower()
        value = a or b or c
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if name == "role" and value.lower() in _ROLES:
            return True, True
        if name not in ("class", "id"):
            continue
        for one in value.split():
            words = set(_WORDS.findall(_CAMEL.sub("-", one).lower()))
            if words & _SAYS_OF_OTHERS:
                continue
            if "header" in words and (in_text or words & _OF_THE_TEXT):
                words.discard("header")
            if words & _PARTS or any(w not in _NOT_STEMS and (w.startswith(_PART_STEMS) or w.endswith(_PART_ENDS) or _ADS.fullmatch(w)) for w in words):
                return True, True
    return False, False


def _lines(page: str) -> tuple[list[_Line], list[_Node]]:
    """The lines of a page in order, and the elements they lie in (parents first)."""
    nodes, stack, open_tags = [_Node(-1, False, False, False, False)], [("", 0)], {}
    lines: list[_Line] = []
    piece: list[str] = []
    linked, in_link, title, gap, regions, pos, end = 0, False, False, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked, title, gap
        if piece:
            text = " ".join("".join(piece).split())
            if text:
                lines.append(_Line(text, stack[-1][1], linked, title, gap))
                gap = 0
            piece.clear()
        linked = 0

    def close() -> None:
        nonlocal regions
        tag, k = stack.pop()
        open_tags[tag] -= 1
        regions -= nodes[k].region or nodes[k].main

    def words(raw: str) -> None:
        nonlocal linked
        if raw:
            text = _html.unescape(raw) if "&" in raw else raw
            piece.append(text)
            if in_link:
                linked += len(text.strip())

    while pos < end:
        m = _MARK.search(page, pos)
        if m is None:
            words(page[pos:])
            break
        words(page[pos : m.start()])
        pos = m.end()
        if m[1]:
            pos = page.find("-->", m.start() + 2) + 3
            if pos < 3:
                break
            continue
        if m[5]:
            # A letter here means that the tag has no end.
            pos = page.find(">", pos) + 1 if not m[5].isalpha() and m[5] != "/" or m[5] == "/" and not page[pos : pos + 1].isalpha() else 0
            if not pos:
                break
            continue
        closing, tag = m[2], m[3].lower()
        block = tag in _BLOCKS
        if closing:
            if tag == "a":
                in_link = False
            if block:
                flush()
                in_link = in_link and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p")
                title = False
                gap += tag != "p"
            elif tag in ("td", "th"):
                piece.append(" ")
            if open_tags.get(tag):
                if not block:
                    flush()
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in _RAW:
            found = _RAW[tag].search(page, pos)
            if found is None:
                break
            pos = found.start()
            continue
        if tag == "br" or tag in ("td", "th"):
            piece.append(" ")
        if tag == "a":
            in_link = True
        if block:
            flush()
            gap += tag != "p"
            title = tag == "h1"
            if stack[-1][0] == "p":
                close()
        for ends in (_ENDS.get(tag, ()),):
            while stack[-1][0] in ends:
                if stack[-1][0] in ("td", "th") and nodes[stack[-1][1]].apart:
                    flush()
                close()
        if tag in _VOID or m[4].endswith("/") and tag in ("svg", "path"):
            continue
        apart, soft = _apart(tag, m[4], regions > 0)
        if not block and not apart and tag not in ("td", "th"):
            continue
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and not apart:
            continue
        if apart and not block:
            flush()
        stack.append((tag, len(nodes)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        region = tag == "article" and not apart
        nodes.append(_Node(stack[-2][1], apart, soft, region, tag == "main"))
        regions += region or tag == "main"
    flush()
    return lines, nodes


def _settle(lines: list[_Line], nodes: list[_Node]) -> None:
    """Makes ``apart`` hold for all that lies inside. A class, header or form that wraps most of a page's text, its title and paragraphs too, or its main element, isn't believed."""
    for line in lines:
        own = nodes[line.node]
        own.size += len(line.text) - line.linked
        own.titles += line.title
        own.paragraphs += 1
    for own in reversed(nodes[1:]):
        above = nodes[own.parent]
        above.size += own.size
        above.titles += own.titles
        above.paragraphs += own.paragraphs
        above.main |= own.main
    whole = nodes[0].size
    for own in nodes[1:]:
        if own.apart and own.soft and (own.main or 2 * own.size > whole and own.titles and own.paragraphs > 2):
            own.apart = False
        own.apart |= nodes[own.parent].apart


def _within(nodes: list[_Node], roots: set[int]) -> list[bool]:
    inside = [False] * len(nodes)
    for k, own in enumerate(nodes):
        inside[k] = k in roots or own.parent >= 0 and inside[own.parent]
    return inside


def spans(lengths: np.ndarray, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of text: a surge is the first line with text from which a window holds more than ``least``, a dive the next line from which a whole window is empty."""
    total = np.concatenate(([0], np.cumsum(lengths)))
    n = len(lengths)
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:-1]
    surges, dives = np.flatnonzero((sums > least) & (lengths > 0)), np.flatnonzero(sums == 0)
    out, at = [], 0
    while (k := int(np.searchsorted(surges, at))) < len(surges):
        first = int(surges[k])
        d = int(np.searchsorted(dives, first))
        at = int(dives[d]) if d < len(dives) else n
        out.append((first, at))
    return out


def main_blocks(page: str) -> list[str]:
    """The article's blocks of text in page order, white space in each turned into single spaces.

    An article or main element says where it lies; text surges and dives there wherever it isn't empty. Without one, lines that are mostly links count as
    empty, text surges where a window is full enough, from the title on if it is in the same stretch, and the element with most of the longest stretch's text gives its other lines too.
    """
    lines, nodes = _lines(page)
    if not lines:
        return []
    regions = {k for k, n in enumerate(nodes) if n.region}
    mains = {k for k, n in enumerate(nodes) if n.main}
    _settle(lines, nodes)
    regions = {k for k in regions if not nodes[k].apart and nodes[k].size}
    mains = {k for k in mains if not nodes[k].apart and nodes[k].size}
    named = bool(regions or mains)
    inside, in_main = _within(nodes, regions or mains), _within(nodes, mains)

    lengths, place = [], []
    for line in lines:
        lengths += [0] * line.gap
        apart = nodes[line.node].apart
        if named:
            counts = not apart and (inside[line.node] or line.title and in_main[line.node])
        else:
            counts = not apart and 2 * line.linked <= len(line.text)
        lengths += [0] * (WINDOW if apart else 1)
        place.append(len(lengths) - 1)
        if counts:
            lengths[-1] = len(line.text)
    sizes = np.array(lengths, np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    fullest = int((total[np.minimum(np.arange(len(sizes)) + WINDOW, len(sizes))] - total[:-1]).max(initial=0))
    found = spans(sizes, 0 if named else SURGE_SHARE * fullest)
    if not found:
        return []
    at = np.array(place)
    keep = np.zeros(len(lines), bool)
    for first, last in found:
        a, b = np.searchsorted(at, (first, last))
        if not named:
            # The stretch goes on before the surge, up to the last empty window; a title there begins the text.
            c = a
            while c and at[c] - at[c - 1] <= WINDOW and sizes[at[c - 1]]:
                c -= 1
            a = next((k for k in range(c, a) if lines[k].title), a)
        keep[a:b] = True
    if not named:
        first, last = max(found, key=lambda s: int(total[s[1]] - total[s[0]]))
        held: dict[int, int] = {}
        for k in range(*np.searchsorted(at, (first, last))):
            held[lines[k].node] = held.get(lines[k].node, 0) + int(sizes[at[k]])
        most = max(held, key=held.__getitem__)
        below = _within(nodes, {most}) if nodes[most].parent > 0 else [k == most for k in range(len(nodes))]
        keep |= np.array([below[line.node] for line in lines])
    return [line.text for k, line in enumerate(lines) if keep[k] and sizes[at[k]]]


def _extract(batches):
    begin("main-text")
    for batch in batches:
        blocks = [main_blocks(page or "") for page in batch.column(0).to_pylist()]
        texts = ["\n\n".join(b) for b in blocks]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "text", "n_chars", "n_blocks"])
    release()


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the columns in ``keep``, text (blocks joined by an empty line), n_chars (its code points), n_blocks.

    Character references are decoded, once. A null or empty page, one without text, or one of menus and notices alone has an empty text. A page of any length is
    read whole in one pass, whatever is left open in it. Rows are independent of each other: repeats give repeated results, ids and addresses may be null. Columns that aren't in ``keep`` are
    ignored, whatever their names; ``keep`` can't name text, n_chars or n_blocks. An empty table gives an empty result.
    """
    own = pages.select(F.col(html_col).cast("string").alias("m_html"), *[F.col(c) for c in keep])
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(_extract, kept + "text string, n_chars long, n_blocks long")
