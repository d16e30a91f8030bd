"""The one Python step: turn page HTML into a node array, in Arrow batches.

Plain, well-nested pages are read together by array operations on their bytes, all others one by one by
``TreeBuilder``, which says what the tree of any page is. Only the tree is built here. Reading it (text, tables, headings, sections) is left to
column expressions in :mod:`docweave.operators`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import codepoint2name, html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa

# Elements without content or end tag.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose text is not page text.
OPAQUE_TAGS = frozenset("script style template rt rp".split())
# Elements in which whitespace-only text keeps its length.
VERBATIM_TAGS = frozenset(("pre", "textarea"))
# Elements that own the text below them; "code" only when nothing else does.
BLOCK_TAGS = frozenset("h1 h2 h3 h4 h5 p li pre th td".split())

NOTHING: list[str] = []
NO_ATTRS: dict[str, str] = {}
TREE_FIELDS = ["page_id", "url", "error", "nodes", "runs"]
NODE_FIELDS = ["ord", "parent", "last", "nth", "tag", "cls", "attrs", "marks", "lo", "hi"]
RUN_FIELDS = ["elem", "block", "marks", "text"]
FLUSH_NODES = 200_000
FLUSH_CHARS = 32_000_000

# Plain constructs, read by one expression: text, end tags, start tags with quoted attributes, complete references; and pieces
# that are whole in themselves, given to HTMLParser as they are. At anything else HTMLParser takes over for the rest of the page.
PLAIN = re.compile(
    r"""([^<&]+)|</([a-zA-Z][a-zA-Z0-9]*)>"""
    r"""|<(?!(?:script|style|textarea|title|iframe|noembed|noframes|xmp|plaintext|noscript)\b)"""
    r"""([a-zA-Z][a-zA-Z0-9]*)((?:[ \n][a-zA-Z][-a-zA-Z0-9_:]*="[^"&<>]*")*)[ ]?(/?)>"""
    r"""|&(?:([a-zA-Z][a-zA-Z0-9]*)|\#([0-9]+|[xX][0-9a-fA-F]+));"""
    r"""|(<(?:(script|style)>(?:[^<]|<(?!!|/\s*(?:script|style)))*</\9|title>(?:[^<&]|&[a-z0-9]+;|&\#[0-9]+;)*</title|!doctype[^<>&]*|!--[^<>&]*--)>)""", re.IGNORECASE | re.ASCII)
QUOTED = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_:]*)="([^"]*)\"""")

_NAMED = {name: chr(code) for code, name in codepoint2name.items()}


def _char(code: int) -> str:
    """Character of a numeric reference; 128-159 follow Windows-1252, bad ones are U+FFFD."""
    if code < 0 or 0xD800 <= code < 0xE000:  # half a pair is no character
        return "\N{REPLACEMENT CHARACTER}"
    if code < 256:
        try:
            return bytes([code]).decode("windows-1252")
        except UnicodeDecodeError:
            pass
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "\N{REPLACEMENT CHARACTER}"


class TreeBuilder(HTMLParser):
    """Tolerant tree: an end tag pops to the nearest open element of its name, else is ignored.

    ``marks`` is inherited: bit i says "inside or equal to an element matching landmark i".
    """

    def __init__(self, landmarks: tuple[str, ...], keep_attrs: bool = False):
        super().__init__(convert_charrefs=False)
        self.by_tag = {s: 1 << i for i, s in enumerate(landmarks) if not s.startswith(".")}
        self.by_class = {s[1:]: 1 << i for i, s in enumerate(landmarks) if s.startswith(".")}
        self.keep_attrs = keep_attrs
        self.nodes: list[list] = []
        self.runs: list[tuple] = []
        self.stack: list[tuple] = []  # (ord, tag, marks, block, weak, opaque, verbatim)
        self.open_count: dict[str, int] = {}
        self.child_count: dict[tuple[int, str], int] = {}
        self.buffer: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Skip a declaration of an unknown kind, like any other; the base class gives up on it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def updatepos(self, i, j):
        return j  # line numbers are not used

    # ---- text

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[0] in "xX" else int(name)
        except ValueError:
            code = -1
        self.buffer.append(_char(code))

    def handle_entityref(self, name):
        known = html5.get(name + ";") or _NAMED.get(name)
        self.buffer.append(known if known is not None else "&" + name)

    def _end_run(self):
        if not self.buffer:
            return
        text = "".join(self.buffer)
        self.buffer = []
        if not self.stack:
            elem, marks, block, verbatim = -1, 0, -1, False
        else:
            elem, _, marks, strong, weak, opaque, verbatim = self.stack[-1]
            if opaque:
                return
            block = strong if strong >= 0 else weak
        if not verbatim and not text.strip(" \n\t\x0c\r"):
            text = "\n" if "\n" in text else " "
        self.runs.append((elem, block, marks, text))

    def _break_run(self, _data):
        self._end_run()

    handle_comment = handle_decl = handle_pi = unknown_decl = _break_run

    # ---- elements

    def handle_starttag(self, tag, attrs):
        self._end_run()
        ord_ = len(self.nodes)
        if self.stack:
            parent, _, marks, strong, weak, opaque, verbatim = self.stack[-1]
        else:
            parent, marks, strong, weak, opaque, verbatim = -1, 0, -1, -1, False, False
        classes, kept = NOTHING, NO_ATTRS
        marks |= self.by_tag.get(tag, 0)
        if attrs:
            for key, value in attrs:
                if key == "class":
                    classes = (value or "").split()
            for name in classes:
                marks |= self.by_class.get(name, 0)
            if self.keep_attrs:
                kept = {key: value or "" for key, value in attrs}
        if tag in BLOCK_TAGS:
            strong = ord_
        elif tag == "code":
            weak = ord_
        nth = self.child_count.get((parent, tag), 0)
        self.child_count[(parent, tag)] = nth + 1
        here = len(self.runs)
        self.nodes.append([ord_, parent, ord_, nth, tag, classes, kept, marks, here, here])
        if tag in VOID_TAGS:
            if tag == "br":
                self.runs.append((ord_, strong if strong >= 0 else weak, marks, None))
                self.nodes[ord_][9] = len(self.runs)
            return
        self.stack.append(
            (ord_, tag, marks, strong, weak, opaque or tag in OPAQUE_TAGS,
             verbatim or tag in VERBATIM_TAGS)
        )
        self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_run()
        if not self.open_count.get(tag):
            return
        while self.stack:
            if self._pop() == tag:
                return

    def _pop(self) -> str:
        ord_, tag = self.stack.pop()[:2]
        self.open_count[tag] -= 1
        self.nodes[ord_][2] = len(self.nodes) - 1
        self.nodes[ord_][9] = len(self.runs)
        return tag

    def _plain(self, html: str) -> int:
        """Read plain constructs as the base class would, only faster; returns where the first other one starts."""
        at = 0
        for found in PLAIN.finditer(html):
            if found.start() != at:
                break
            kind = found.lastindex
            if kind == 1:
                self.buffer.append(found[1])
            elif kind == 2:
                self.handle_endtag(found[2].lower())
            elif kind == 5:
                attrs = [(name.lower(), value) for name, value in QUOTED.findall(found[4])] if found[4] else NOTHING
                (self.handle_startendtag if found[5] else self.handle_starttag)(found[3].lower(), attrs)
            elif kind == 6:
                self.handle_entityref(found[6])
            elif kind == 7:
                self.handle_charref(found[7])
            else:
                self.feed(found[8])
                if self.rawdata or self.cdata_elem:
                    return found.end()
            at = found.end()
        return at

    def build(self, html: str):
        self.feed(html[self._plain(html):])
        self.close()
        self._end_run()
        while self.stack:
            self._pop()
        return self.nodes, self.runs


def _offsets(groups) -> pa.Array:
    total, out = 0, [0]
    for group in groups:
        total += len(group)
        out.append(total)
    return pa.array(out, pa.int32())


def _struct(names, arrays):
    return pa.StructArray.from_arrays(arrays, names=names)


def _node_array(pages: list[list]) -> pa.Array:
    flat = [node for page in pages for node in page]
    cols = list(zip(*flat)) if flat else [()] * 10
    classes = pa.ListArray.from_arrays(
        _offsets(cols[5]), pa.array([c for cs in cols[5] for c in cs], pa.string())
    )
    attrs = pa.MapArray.from_arrays(
        _offsets(cols[6]),
        pa.array([k for a in cols[6] for k in a], pa.string()),
        pa.array([v for a in cols[6] for v in a.values()], pa.string()),
    )
    ints = [pa.array(cols[i], pa.int32()) for i in (0, 1, 2, 3)]
    rest = [pa.array(cols[7], pa.int64()), pa.array(cols[8], pa.int32()), pa.array(cols[9], pa.int32())]
    values = _struct(
        NODE_FIELDS,
        [*ints, pa.array(cols[4], pa.string()), classes, attrs, *rest],
    )
    return pa.ListArray.from_arrays(_offsets(pages), values)


def _run_array(pages: list[list]) -> pa.Array:
    flat = [run for page in pages for run in page]
    cols = list(zip(*flat)) if flat else [()] * 4
    types = (pa.int32(), pa.int32(), pa.int64(), pa.string())
    values = _struct(
        RUN_FIELDS, [pa.array(c, t) for c, t in zip(cols, types)]
    )
    return pa.ListArray.from_arrays(_offsets(pages), values)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, urls, errors, nodes, runs = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(urls, pa.string()),
            pa.array(errors, pa.string()),
            _node_array(list(nodes)),
            _run_array(list(runs)),
        ],
        names=TREE_FIELDS,
    )


# ---------------------------------------------------------------- many pages at once

# Bytes of pages read together, and levels of elements up to which they are.
TOGETHER, DEEPEST = 2_000_000, 200
# Slices left to the builder at most, after ones with hardly a page that could be read together.
MOST_SKIPPED = 15
# What may stand between < and > in a page read together; attributes as in PLAIN.
START = re.compile(r"""([a-z][a-z0-9]*)((?:[ \n][a-z][-a-z0-9_:]*="[^"&<>]*")*)[ ]?(/?)""", re.IGNORECASE | re.ASCII)
END = re.compile(r"/([a-z][a-z0-9]*)", re.IGNORECASE | re.ASCII)
BREAK = re.compile(r"!doctype[^<>&]*|!--[^<>&]*--", re.IGNORECASE | re.ASCII)
# What may end, or upset, the text of a script or style.
RAW_STOP = re.compile(r"!|/\s*(?:script|style)", re.IGNORECASE | re.ASCII)
RAW_TAGS = frozenset(("script", "style"))
# Elements whose text is read in ways of its own.
OWN_WAYS = frozenset("textarea iframe noembed noframes xmp plaintext noscript".split())
REFERENCE = re.compile(r"&(?:([a-zA-Z][a-zA-Z0-9]*)|#([0-9]+|[xX][0-9a-fA-F]+));", re.ASCII)
ODD, OPEN, CLOSE, LEAF, GAP, RAW, TITLE = range(7)


class _Tag:
    """What a piece between < and > stands for."""

    def __init__(self, text: str, builder: TreeBuilder):
        self.kind, self.tag, self.classes, self.attrs, self.marks = ODD, "", NOTHING, NO_ATTRS, 0
        self.stops = RAW_STOP.match(text) is not None
        if found := END.fullmatch(text):
            self.tag = found[1].lower()
            self.kind = GAP if self.tag in VOID_TAGS else CLOSE
        elif BREAK.fullmatch(text):
            self.kind = GAP
        elif found := START.fullmatch(text):
            self.tag = found[1].lower()
            special = self.tag in RAW_TAGS or self.tag == "title"
            if self.tag in OWN_WAYS or special and (found[3] or self.tag == "title" and found[2]):
                return
            self.kind = LEAF if found[3] or self.tag in VOID_TAGS else RAW if self.tag in RAW_TAGS else TITLE if special else OPEN
            builder.handle_starttag(self.tag, [(name.lower(), value) for name, value in QUOTED.findall(found[2])])
            _, _, _, _, _, self.classes, self.attrs, self.marks, _, _ = builder.nodes[0]


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` end to end, and their offsets."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def _strings(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None, kind=pa.string()) -> pa.Array:
    bits = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(kind, len(offsets) - 1, [bits, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _resolved(text: str) -> str | None:
    """Text with its references replaced, as the builder does; None if one is not complete."""
    if "&" in REFERENCE.sub("", text):
        return None
    out = TreeBuilder(())

    def one(found: re.Match) -> str:
        out.buffer.clear()
        (out.handle_entityref if found[1] else out.handle_charref)(found[1] or found[2])
        return out.buffer[0]

    return REFERENCE.sub(one, text)


def read_together(data: np.ndarray, bounds: np.ndarray, landmarks: tuple[str, ...], keep_attrs: bool):
    """Trees of the pages ``data[bounds[k] : bounds[k + 1]]``: which pages could be read, their node arrays and run arrays.

    A page is read here if all it holds is text, complete references, plain tags, comments and scripts, and every element
    is closed where it should be. Pieces run from one < to the next. Matching tags are neighbours when pieces are sorted
    by page and level; what elements inherit goes down level by level.
    """
    pages = len(bounds) - 1
    good = np.ones(pages, bool)
    lt = np.flatnonzero(data == 60)
    page = np.searchsorted(bounds, lt, side="right") - 1
    stop = np.minimum(np.append(lt[1:], len(data)), bounds[page + 1])
    gts = np.append(np.flatnonzero(data == 62), len(data))
    gt = gts[np.searchsorted(gts, lt)]
    whole = gt < stop
    pieces = _strings(*_gathered(data, lt + 1, np.where(whole, gt - lt - 1, np.minimum(stop - lt - 1, 64))), kind=pa.binary()).dictionary_encode()
    which = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    tags = [_Tag(x.decode(errors="replace"), TreeBuilder(landmarks, keep_attrs)) for x in pieces.dictionary.to_pylist()]
    names: dict[str, int] = {}
    tag = np.array([names.setdefault(t.tag, len(names)) for t in tags], np.int64)[which]
    kind = np.where(whole, np.array([t.kind for t in tags], np.int64)[which], ODD)

    # Scripts: what stands between their tags is no piece of its own.
    keep = np.ones(len(lt), bool)
    stops = np.flatnonzero(np.array([t.stops for t in tags], bool)[which])
    raw, done = np.flatnonzero(kind == RAW), -1
    for t, s in zip(raw.tolist(), np.searchsorted(stops, raw, side="right").tolist()):
        if t > done:
            end = int(stops[s]) if s < len(stops) else -1
            if end > 0 and page[end] == page[t] and kind[end] == CLOSE and tag[end] == tag[t]:
                keep[t + 1 : end] = False
                done = end
            else:
                good[page[t]] = False
    # Text before the first piece of a page and after each piece.
    first = np.append(lt, len(data))[np.searchsorted(lt, bounds[:-1])]
    start = np.concatenate([bounds[:-1], np.where(whole, gt + 1, stop)])
    size = np.concatenate([np.minimum(first, bounds[1:]) - bounds[:-1], stop - start[pages:]])
    after = np.concatenate([np.full(pages, -1), np.arange(len(lt))])
    text_page = np.concatenate([np.arange(pages), page])
    shown = (size > 0) & np.concatenate([np.ones(pages, bool), keep])
    amps = np.flatnonzero(data == 38)
    with_amp = shown & (np.searchsorted(amps, start) < np.searchsorted(amps, start + size))
    with_amp[pages:] &= kind != RAW
    resolved: dict[int, str] = {}
    for k in np.flatnonzero(with_amp).tolist():
        text = _resolved(data[start[k] : start[k] + size[k]].tobytes().decode())
        if text is None:
            good[text_page[k]] = False
        else:
            resolved[k] = text
    # A title holds plain text only.
    titles = np.flatnonzero(keep & (kind == TITLE))
    nxt = np.minimum(titles + 1, len(lt) - 1)
    closed = (nxt > titles) & (page[nxt] == page[titles]) & (kind[nxt] == CLOSE) & (tag[nxt] == tag[titles]) & ~with_amp[pages + titles]
    good[page[titles[~closed]]] = False
    good[page[keep & (kind == ODD)]] = False
    opens = (kind == OPEN) | (kind == RAW) | (kind == TITLE)

    # Levels: that of an element for its two tags, that of the element around it for others.
    step = (opens.astype(np.int64) - (kind == CLOSE)) * keep
    depth = np.cumsum(step)
    base = np.append(0, depth)[np.searchsorted(lt, bounds)]
    level = depth - base[page]
    good &= base[1:] == base[:-1]
    good[page[(level < 0) | (level > DEEPEST)]] = False
    level += kind == CLOSE
    t = np.flatnonzero(keep & good[page])
    ends = t[opens[t] | (kind[t] == CLOSE)]
    ends = ends[np.argsort(page[ends] * (DEEPEST + 2) + level[ends], kind="stable")]
    left, right = ends[::2], ends[1::2]
    good[page[left[tag[left] != tag[right]]]] = False
    fine = good[page[left]]
    left, right, t = left[fine], right[fine], t[good[page[t]]]

    # Nodes, and the one around every piece.
    is_node = np.zeros(len(lt), bool)
    is_node[t] = opens[t] | (kind[t] == LEAF)
    at = np.flatnonzero(is_node)
    number = np.cumsum(is_node) - 1
    place = page * (DEEPEST + 2)
    opened = (place[left] + level[left]) * len(lt) + left
    around = np.full(len(lt), -1)
    inner = t[kind[t] != CLOSE]
    outer = level[inner] - opens[inner]
    inner, outer = inner[outer > 0], outer[outer > 0]
    around[inner] = number[left[np.searchsorted(opened, (place[inner] + outer) * len(lt) + inner) - 1]]
    within = around.copy()
    within[right] = around[left]
    within[left] = number[left]
    parent = around[at]
    nodes = len(at)
    last = np.arange(nodes)
    last[number[left]] = number[right]
    is_tag = lambda some: np.array([x in some for x in names], bool)[tag[at]]
    own = np.array([x.marks for x in tags], np.int64)[which[at]]
    strong = np.where(is_tag(BLOCK_TAGS), np.arange(nodes), -1)
    weak = np.where(is_tag(("code",)), np.arange(nodes), -1)
    opaque, verbatim = is_tag(OPAQUE_TAGS), is_tag(VERBATIM_TAGS)
    high = level[at] + ~opens[at]
    by_level = np.argsort(high, kind="stable")
    cuts = np.searchsorted(high[by_level], np.arange(2, high.max(initial=0) + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        some = by_level[a:b]
        above = parent[some]
        own[some] |= own[above]
        opaque[some] |= opaque[above]
        verbatim[some] |= verbatim[above]
        for block in (strong, weak):
            block[some] = np.where(block[some] < 0, block[above], block[some])
    order = np.lexsort((tag[at], np.where(parent < 0, -1 - page[at], parent)))
    same = np.zeros(nodes, bool)
    a, b = order[:-1], order[1:]
    same[1:] = (tag[at[a]] == tag[at[b]]) & (parent[a] == parent[b]) & ((parent[a] >= 0) | (page[at[a]] == page[at[b]]))
    begun = np.flatnonzero(~same)
    nth = np.zeros(nodes, np.int64)
    nth[order] = np.arange(nodes) - np.repeat(begun, np.diff(np.append(begun, nodes)))
    block = np.where(strong >= 0, strong, weak)

    # Runs: texts, and line breaks, which have none.
    elem = np.append(within, -1)[after]
    shown &= good[text_page]
    shown[shown] = (elem[shown] < 0) | ~opaque[elem[shown]]
    texts = np.flatnonzero(shown)
    breaks = at[tag[at] == names.get("br", -1)]
    breaks = breaks[kind[breaks] == LEAF]
    where = np.concatenate([start[texts], lt[breaks]])
    elem = np.concatenate([elem[texts], number[breaks]])
    turn = np.argsort(where, kind="stable")
    begin, length = start[texts], size[texts].copy()
    space = (data == 32) | (data == 10) | (data == 9) | (data == 12) | (data == 13)
    solid, lines = (np.append(0, np.cumsum(x)) for x in (~space, data == 10))
    blank = solid[begin] == solid[begin + length]
    blank &= (elem[: len(texts)] < 0) | ~verbatim[elem[: len(texts)]]
    marks = np.where(lines[begin] < lines[begin + length], 10, 32)
    encoded = {}
    for k in np.flatnonzero(with_amp[texts]).tolist():
        text, e = resolved[int(texts[k])], int(elem[k])
        if not (e >= 0 and verbatim[e]) and not text.strip(" \n\t\x0c\r"):
            text = "\n" if "\n" in text else " "
        encoded[k] = np.frombuffer(text.encode(), np.uint8)
    length[blank] = 1
    parts = data
    if encoded:  # texts without their references stand after the data
        keys = np.fromiter(encoded, np.int64)
        length[keys] = [len(x) for x in encoded.values()]
        begin[keys] = len(data) + np.cumsum(length[keys]) - length[keys]
        parts = np.concatenate([data, *encoded.values()])
    starts, lengths = (np.append(x, np.zeros(len(breaks), np.int64))[turn] for x in (begin, length))
    chars, offsets = _gathered(parts, starts, lengths)
    empty = np.append(blank, np.zeros(len(breaks), bool))[turn]
    chars[offsets[:-1][empty]] = np.append(marks, np.zeros(len(breaks), np.int64))[turn][empty]
    where, elem = where[turn], elem[turn]
    run_from = np.searchsorted(where, bounds)
    lo = np.searchsorted(where, lt[at])
    hi = lo + np.isin(at, breaks)
    hi[number[left]] = np.searchsorted(where, lt[right])

    # Numbers within the page.
    node_from = np.append(0, np.cumsum(is_node))[np.searchsorted(lt, bounds)]
    shift = node_from[page[at]]
    run_shift = node_from[np.searchsorted(bounds, where, side="right") - 1]
    local = lambda x, by: np.where(x < 0, -1, x - by)
    ints = [np.arange(nodes) - shift, local(parent, shift), last - shift, nth]
    kinds = pa.array(which[at])
    classes = pa.array([x.classes for x in tags], pa.list_(pa.string())).take(kinds)
    if keep_attrs:
        attrs = pa.array([list(x.attrs.items()) for x in tags], pa.map_(pa.string(), pa.string())).take(kinds)
    else:
        attrs = pa.MapArray.from_arrays(pa.array(np.zeros(nodes + 1, np.int32)), pa.array([], pa.string()), pa.array([], pa.string()))
    below = run_from[page[at]]
    node_values = _struct(NODE_FIELDS, [
        *(pa.array(x.astype(np.int32)) for x in ints), pa.array(list(names) or [""], pa.string()).take(pa.array(tag[at])), classes, attrs, pa.array(own),
        *(pa.array((x - below).astype(np.int32)) for x in (lo, hi))])
    inside = elem >= 0
    run_marks, run_block = np.zeros(len(elem), np.int64), np.full(len(elem), -1)
    run_marks[inside], run_block[inside] = own[elem[inside]], block[elem[inside]]
    valid = np.append(np.ones(len(texts), bool), np.zeros(len(breaks), bool))[turn]
    run_values = _struct(RUN_FIELDS, [
        *(pa.array(local(x, run_shift).astype(np.int32)) for x in (elem, run_block)), pa.array(run_marks), _strings(chars, offsets, valid)])
    lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values) for cuts, values in ((node_from, node_values), (run_from, run_values))]
    return good, *lists


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batch in slices of few bytes, with the bytes of their pages and the bounds of each."""
    pages = batch.column(2).cast(pa.large_string())
    buffers = pages.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[pages.offset : pages.offset + len(pages) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(pages):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, side="right")) - 1)
        yield batch.slice(at, end - at), data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]
        at = end


def shredder(landmarks: tuple[str, ...], keep_attrs: bool = False):
    """Return the ``mapInArrow`` function for batches of (page_id, url, html)."""

    def shred_page(html):
        if html is None:
            return "no content", [], []
        try:
            return None, *TreeBuilder(landmarks, keep_attrs).build(html)
        except Exception as problem:  # one bad page must not stop the job
            return f"parse error: {problem}", [], []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, chars = [], 0, 0
        skip = pause = 0
        for batch in batches:
            for part, data, bounds in _slices(batch):
                good = np.zeros(len(part), bool)
                if skip:  # pages like the last ones are hardly worth another try
                    skip -= 1
                else:
                    good, nodes, runs = read_together(data, bounds, landmarks, keep_attrs)
                    good &= part.column(2).is_valid().to_numpy(zero_copy_only=False)
                    pause = 0 if 4 * good.sum() >= len(good) else min(2 * pause + 1, MOST_SKIPPED)
                    skip = pause
                if good.any():
                    ids, urls = part.column(0).cast(pa.int64()), part.column(1).cast(pa.string())
                    read = pa.RecordBatch.from_arrays([ids, urls, pa.nulls(len(ids), pa.string()), nodes, runs], names=TREE_FIELDS)
                    yield read if good.all() else read.filter(pa.array(good))
                if good.all():
                    continue
                for page_id, url, html in zip(*(column.to_pylist() for column in part.filter(pa.array(~good)).columns)):
                    error, nodes, runs = shred_page(html)
                    rows.append((page_id, url, error, nodes, runs))
                    size += len(nodes) + len(runs)
                    chars += len(html or "")
                    if size >= FLUSH_NODES or chars >= FLUSH_CHARS:
                        yield _batch(rows)
                        rows, size, chars = [], 0, 0
        if rows:
            yield _batch(rows)

    return run
