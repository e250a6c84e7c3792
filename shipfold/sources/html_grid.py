"""HTML grid scan (S5, J6, A12 inputs).

Pages are read one per record inside ``mapInArrow`` (one page at a time of a batch, one
pass over its tags); Spark partitions the pages, so the scan scales with the
number of executors. Output is long and uniform::

    page_id, kind ('cell' | 'page'), row_no, col_no, label, value, in_body,
    reported_total, dom_rows, body_rows

``cell`` rows are grid cells; one ``page`` row per page carries the grid's
reported total text and its row counts, so a page with an empty grid is
still reported.

The reader is a handler of tags as they come: it knows which zone of the grid
it is in and which texts it is collecting. No tree is built and nothing recurses, so
deep or unclosed markup costs no more than its length; optional end tags of list
items and table parts are implied.

Grid rules: only the main header wrapper's first header row is read; the
gutter cell is skipped; the selection column is kept for positioning but yields no
cell; a header's label is the text of the first direct ``span`` child of its
``.cell`` (else the ``.cell`` text), so a filter widget's option list is never
swept up; body rows are the ``tr.el-table__row`` elements inside the body wrapper's
table body only, never the frozen clone; text has the browser's white space
collapsed and entities decoded.
"""

from __future__ import annotations

import re
import sys
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The parse functions run in Python workers. Pickle this module by value so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older pickler: the package must be on the workers
    pass

GRID_SCHEMA = ("page_id long, kind string, row_no int, col_no int, label string, "
               "value string, in_body boolean, reported_total string, dom_rows int, "
               "body_rows int")

# FIXED VALUES: class names of the grid markup the scan understands.
ROOT, HEADER_WRAPPER, BODY_WRAPPER = "el-table", "el-table__header-wrapper", "el-table__body-wrapper"
ROW, CELL_TD, CELL = "el-table__row", "el-table__cell", "cell"
GUTTER, SELECTION, TOTAL = "gutter", "el-table-column--selection", "el-pagination__total"

# A batch handed back to Spark ends after so many rows, or rows of pages of so many characters.
OUT_CHUNK, OUT_CHARS = 20_000, 8 << 20

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
         "param", "source", "track", "wbr"}
_BLOCK = {"br", "p", "div", "li", "tr", "td", "th", "ul", "ol", "table", "h1", "h2", "h3"}
# Tags whose end may be left out: a tag that opens ends those of its set that are
# the innermost structural ones.
_ENDS = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
         **dict.fromkeys(("thead", "tbody", "tfoot"), {"td", "th", "tr", "thead", "tbody", "tfoot"})}
_STRUCTURE = {*_ENDS, "ul", "ol", "menu", "table"}
_COLLECTED = {"total", "td", "cell", "span", "th"}  # zones whose text is kept

# FIXED VALUES: white space as a browser sees it, here for Python workers.
_SPACE = re.compile("[\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def collapse(s: str) -> str:
    return _SPACE.sub(" ", s).strip(" ")


# A tag, comment or declaration; a value in quotes after an equals sign may hold any character.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:"[^"]*+"|'[^']*+')?+|[^>=]++)*+)>""", re.S)
# The same as one group, tags first.
_PIECE = re.compile(r"""(</?[a-zA-Z][^\s/>]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+|[^>=]++)*+>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>)""", re.S)
_CUT_TAG = re.compile("</?[a-zA-Z]|<[!?]")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
# Elements whose content is text up to their end tag; entities count in the latter two.
_RAW = {"script", "style", "textarea", "title"}
_RAW_TAG = re.compile("<(?:" + "|".join(sorted(_RAW)) + ")", re.I)
_SPLIT_CHARS = 1 << 20  # longer pages are cut at their tags one by one, for memory's sake
_KNOWN_TAGS, _KNOWN_CHARS = 4096, 512  # tags remembered per worker, and how long they may be
_tokens: dict[str, _Token] = {}


def _classes(attributes: str) -> frozenset:
    """The class names of a tag's attribute text."""
    value = ""
    if "class" in attributes.lower():
        for name, text in _ATTRIBUTE.findall(attributes):
            if name.lower() == "class":
                value = unescape(text[1:-1] if text[:1] in ("'", '"') else text)
    return frozenset(value.split())


# Tags and classes that can open a zone.
_ZONE_TAGS = {"span", "th", "thead", "tbody", "tr"}
_ZONE_CLASSES = {ROOT, HEADER_WRAPPER, BODY_WRAPPER, CELL_TD, CELL, TOTAL}


class _Token(NamedTuple):
    """What a tag's text says, wherever it stands."""
    tag: str | None          # None: a comment or declaration
    closes: bool = False
    classes: frozenset = frozenset()
    empty: bool = False      # a start tag that ends itself
    zone: int = 0            # may open a zone: any, or inside a row one kind at most
    ends: frozenset | set = frozenset()  # tags whose end it implies
    block: bool = False
    void: bool = False
    structure: bool = False
    raw: bool = False


# What a tag may open: any zone, or, if it stands in a row, a cell, a table cell or none.
ANY_ZONE, CELL_ZONE, TD_ZONE, NO_ROW_ZONE = 1, 2, 3, 4


def _may_zone(tag: str, classes: frozenset) -> int:
    if tag not in _ZONE_TAGS and classes.isdisjoint(_ZONE_CLASSES):
        return 0
    cell, td = CELL in classes, tag == "td" and CELL_TD in classes
    if TOTAL in classes or cell and td:
        return ANY_ZONE
    return CELL_ZONE if cell else TD_ZONE if td else NO_ROW_ZONE


def _token(mark: str) -> _Token:
    m = _TAG.fullmatch(mark)
    tag = m[2] and m[2].lower()
    if not tag or m[1]:
        token = _Token(tag, closes=True, structure=tag in _STRUCTURE)
    else:
        classes, empty = _classes(m[3]), m[3].endswith("/") and tag not in _VOID
        token = _Token(tag, False, classes, empty, _may_zone(tag, classes), _ENDS.get(tag, frozenset()),
                       tag in _BLOCK, tag in _VOID, tag in _STRUCTURE, tag in _RAW and not empty)
    if len(mark) <= _KNOWN_CHARS and len(_tokens) < _KNOWN_TAGS:
        _tokens[mark] = token
    return token


def _pieces(html: str):
    """Each tag, comment or declaration with the text before it, one at a time."""
    at = 0
    for m in _PIECE.finditer(html):
        start, end = m.span()
        yield html[at:start], m.group()
        at = end


class _GridReader:
    """Zones of one page, by what is open: each open tag may carry a zone name.

    A zone that may come once (``root``, ``head``, ``thead``, ``labels``, ``body``) is
    entered by the first tag that fits. Collected texts are lists that grow while
    their zone is open.
    """

    def __init__(self):
        self.open: list[tuple[str, str | None]] = []
        self.count: dict[str, int] = {}    # open tags by name
        self.nested: list[tuple[str, int]] = []  # structural tags and their places in ``open``
        self.inside: dict[str, int] = {}   # open zones by name
        self.seen: set[str] = set()
        self.sinks: dict[str, list[str]] = {}  # texts that grow
        self.texts: dict[str, str] = {}        # those of closed cells and spans
        self.total: str | None = None
        self.columns: list[str | None] = []  # one for each header cell but the gutter
        self.places: list[int] = []          # their positions among all header cells
        self.header_cells = 0
        self.rows: list[tuple[bool, list[str]]] = []

    def _first(self, zone: str) -> bool:
        if zone in self.seen:
            return False
        self.seen.add(zone)
        return True

    def _has(self, zone: str) -> bool:
        return zone in self.sinks or zone in self.texts

    def _zone(self, tag: str, classes: frozenset) -> str | None:
        """The zone that this tag opens, given those that are open."""
        inside = self.inside
        if TOTAL in classes and self._first("total"):
            return "total"
        if inside.get("row"):  # rows lie in the root, outside the labels
            if inside.get("td"):
                return "cell" if CELL in classes and not self._has("cell") else None
            return "td" if tag == "td" and CELL_TD in classes else None
        if not inside.get("root"):
            return "root" if ROOT in classes and self._first("root") else None
        if inside.get("labels"):
            if inside.get("cell"):
                direct = self.open and self.open[-1][1] == "cell"
                return "span" if tag == "span" and direct and not self._has("span") else None
            if inside.get("th"):
                return "cell" if CELL in classes and not self._has("cell") else None
            direct = self.open and self.open[-1][1] == "labels"
            if tag == "th" and direct:
                position, self.header_cells = self.header_cells, self.header_cells + 1
                if GUTTER in classes:
                    return None
                self.places.append(position)
                self.columns.append(None)
                return None if SELECTION in classes else "th"
            return None
        if tag == "tr" and ROW in classes:
            self.rows.append((bool(inside.get("tbody")), []))
            return "row"
        if inside.get("head"):
            if tag == "thead" and self._first("thead"):
                return "thead"
            return "labels" if tag == "tr" and inside.get("thead") and self._first("labels") else None
        if HEADER_WRAPPER in classes and self._first("head"):
            return "head"
        if BODY_WRAPPER in classes and self._first("body"):
            return "body"
        return "tbody" if tag == "tbody" and inside.get("body") else None

    def read(self, html: str) -> None:
        known, sinks, open_, nested, count, inside = _tokens.get, self.sinks, self.open, self.nested, self.count, self.inside
        whole = len(html) <= _SPLIT_CHARS and not _RAW_TAG.search(html)
        if whole:  # cut at once; places are not needed
            pieces = _PIECE.split(html)
            pairs = zip(pieces[::2], pieces[1::2])
        else:
            pairs = _pieces(html)
        at, raw_to = 0, 0  # where the piece ends, and the raw text that it may lie in
        for text, mark in pairs:
            if not whole:
                at += len(text)
                if raw_to:
                    if at < raw_to:  # inside the text of a raw element
                        at += len(mark)
                        continue
                    text, raw_to = html[raw_to:at], 0
                at += len(mark)
            if text and sinks:
                self._text(text)
            tag, closes, classes, empty, may_zone, ends, block, void, structure, raw = known(mark) or _token(mark)
            if closes:
                if open_ and open_[-1][0] == tag:
                    zone = open_.pop()[1]
                    count[tag] -= 1
                    if structure and nested[-1][1] == len(open_):
                        nested.pop()
                    if zone:
                        self._left(zone)
                elif tag:
                    self._end(tag)
                continue
            while ends and nested and nested[-1][0] in ends:
                if nested[-1][1] == len(open_) - 1:
                    self._close_one()
                else:
                    self._close_to(nested[-1][1])
            zone = None
            if may_zone > ANY_ZONE and inside.get("row"):  # as ``_zone`` has it, without the call
                if inside.get("td"):
                    if may_zone == CELL_ZONE and "cell" not in sinks and "cell" not in self.texts:
                        zone = "cell"
                elif may_zone == TD_ZONE:
                    zone = "td"
            elif may_zone:
                zone = self._zone(tag, classes)
            if block and sinks and not inside.get("labels"):
                for name in ("td", "cell"):
                    if name in sinks:
                        sinks[name].append("\n")
            if void:
                continue
            if structure:
                nested.append((tag, len(open_)))
            open_.append((tag, zone))
            count[tag] = count.get(tag, 0) + 1
            if zone:
                inside[zone] = inside.get(zone, 0) + 1
                if zone in _COLLECTED:
                    if zone == "cell":  # its text stands for the table cell's
                        sinks.pop("td", None)
                    sinks[zone] = []
            if empty:
                self._end(tag)
            elif raw:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                raw_to = end.start() if end else len(html)
                for sink in sinks.values():
                    sink.append(html[at:raw_to] if tag in ("script", "style") else unescape(html[at:raw_to]))
                if raw_to == at:
                    raw_to = 0
        rest = pieces[-1] if whole else html[raw_to or at:]
        if rest and sinks:
            cut = _CUT_TAG.search(rest)  # a tag that the page's end cuts off is no text
            self._text(rest[:cut.start()] if cut else rest)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        for sink in self.sinks.values():
            sink.append(text)

    def _end(self, tag: str) -> None:
        if self.count.get(tag):
            at = len(self.open) - 1
            while self.open[at][0] != tag:
                at -= 1
            self._close_to(at)

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            self._close_one()

    def _close_one(self) -> None:
        tag, zone = self.open.pop()
        self.count[tag] -= 1
        if self.nested and self.nested[-1][1] == len(self.open):
            self.nested.pop()
        if zone:
            self._left(zone)

    def _left(self, zone: str) -> None:
        self.inside[zone] -= 1
        if zone in _COLLECTED:
            self._leave(zone)

    def _leave(self, zone: str) -> None:
        text = collapse("".join(self.sinks.pop(zone))) if zone in self.sinks else ""
        if zone == "total":
            self.total = text
        elif zone == "td":
            self.rows[-1][1].append(self.texts.pop("cell", text))
        elif zone == "th":
            cell = self.texts.pop("cell", "")
            self.columns[-1] = self.texts.pop("span", cell)
        else:
            self.texts[zone] = text

    def finish(self) -> None:
        self._close_to(0)


def _read_page(html: str | None) -> _GridReader:
    page = _GridReader()
    page.read(html or "")
    page.finish()
    return page


def extract_grid(page_id: int, html: str) -> list[tuple]:
    """Rows for one page in ``GRID_SCHEMA`` order."""
    batch = pa.RecordBatch.from_pydict({"page_id": [page_id], "html": pa.array([html], pa.string())})
    return [tuple(r.values()) for out in _scanner()([batch]) for r in out.to_pylist()]


def _scanner():
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split() for c in GRID_SCHEMA.split(", "))])

    def add(columns, page_id, page):
        """A page's rows as ``extract_grid`` has them, column by column."""
        ids, kind, row_no, col_no, label, value, body, *counts = columns
        heads = [(place, c, name) for c, (place, name) in enumerate(zip(page.places, page.columns)) if name]
        n, start = 0, len(col_no)
        for in_body, cells in page.rows:
            here = heads if not heads or heads[-1][0] < len(cells) else [h for h in heads if h[0] < len(cells)]
            value += [cells[place] for place, _, _ in here]
            col_no += [c for _, c, _ in here]
            label += [name for _, _, name in here]
            row_no += [n if in_body else None] * len(here)
            body += [in_body] * len(here)
            n += in_body
        new = len(col_no) - start
        ids += [page_id] * (new + 1)
        kind += ["cell"] * new + ["page"]
        for column in (row_no, col_no, label, value, body):
            column.append(None)
        for column, count in zip(counts, (page.total, len(page.rows), n)):
            column += [None] * new + [count]

    def scan(batches):
        columns, chars = [[] for _ in schema], 0
        for b in batches:
            # One page at a time becomes a Python text; the batch stays as Arrow holds it.
            for page_id, html in zip(b.column(0), b.column(1)):
                text = html.as_py()
                add(columns, page_id.as_py(), _read_page(text))
                chars += len(text or "")
                if len(columns[0]) >= OUT_CHUNK or chars >= OUT_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                    columns, chars = [[] for _ in schema], 0
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return scan


def grid_scan(pages: DataFrame, spread: bool = True) -> DataFrame:
    """Parse ``pages(page_id, html)`` into the long grid frame.

    Parsing is CPU-bound per page, so an input with fewer partitions than the
    cluster has cores (a few small files) is spread out first; a large table
    is parsed where it lies. To count its partitions, a shuffle in front is run
    once more: pages that come out of one need no spreading (``spread=False``).
    """
    from shipfold.session import default_parallelism, partition_count
    src = pages.select("page_id", "html")
    cores = default_parallelism(pages.sparkSession)
    if spread and (partition_count(src) or cores) < cores:
        src = src.repartition(cores)
    return src.mapInArrow(_scanner(), GRID_SCHEMA)


def grid_cells(scan: DataFrame) -> DataFrame:
    """Body cells only: ``page_id, row_no, col_no, label, value``."""
    return (scan.filter((F.col("kind") == "cell") & F.col("in_body"))
            .select("page_id", "row_no", "col_no", "label", "value"))


def grid_pages(scan: DataFrame) -> DataFrame:
    return (scan.filter(F.col("kind") == "page")
            .select("page_id", "reported_total", "dom_rows", "body_rows"))
