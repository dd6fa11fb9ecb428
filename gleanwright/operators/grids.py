"""Tables of web pages as grids of cells and as groups of rows that can be searched.

Spans are resolved as browsers do: a cell takes the next free place of its row, covers its columns and rows, and what spans rows ends
with its row group (thead, tbody, tfoot). A group of rows carries the table's title and, in each row, the names of the columns; rows
that one cell spans stay together.

Defined cases: a page without tables, or a null one, has no rows; a table inside a cell is a table of its own, and its text is not the
outer cell's; missing end tags end where the next cell, row or table begins; spans that are no numbers are 1, and rowspan 0 goes to the
end of the row group; script and style are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ready, spread

MUTE = ("script", "style", "noscript", "iframe")
#: The largest spans that browsers follow.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass
class Cell:
    header: bool
    columns: int
    rows: int
    words: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.words).split())


@dataclass
class Table:
    heading: str
    caption: list[str] = field(default_factory=list)
    groups: list[list[list[Cell]]] = field(default_factory=list)
    in_caption: bool = False
    cell: Cell | None = None

    @property
    def title(self) -> str:
        return " ".join(" ".join(self.caption).split()) or self.heading


@dataclass(frozen=True)
class Spot:
    """A place of the grid: its cell's text, and whether the cell began in an earlier row or column."""

    text: str
    header: bool
    from_above: bool
    from_left: bool


def _span(value: str | None, most: int) -> int:
    return min(int(value), most) if value and value.strip().isascii() and value.strip().isdigit() else 1


class _Walk(HTMLParser):
    """All tables of a page, in the order in which they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Table] = []
        self.open: list[Table] = []
        self.heading: list[str] = []
        self.in_heading = False
        self.mute = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        at = dict(attrs)
        if tag in MUTE:
            self.mute += 1
        elif tag in ("h1", "h2", "h3", "h4") and not self.open:
            self.heading, self.in_heading = [], True
        elif tag == "table":
            table = Table(" ".join(" ".join(self.heading).split()))
            self.tables.append(table)
            self.open.append(table)
        elif self.open:
            t = self.open[-1]
            if tag == "caption":
                t.in_caption, t.cell = True, None
            elif tag in ("thead", "tbody", "tfoot"):
                t.groups.append([])
                t.cell = None
            elif tag == "tr":
                if not t.groups:
                    t.groups.append([])
                t.groups[-1].append([])
                t.cell, t.in_caption = None, False
            elif tag in ("td", "th"):
                if not t.groups or not t.groups[-1]:
                    t.groups.append([[]]) if not t.groups else t.groups[-1].append([])
                t.cell = Cell(tag == "th", max(1, _span(at.get("colspan"), MOST_COLUMNS)), _span(at.get("rowspan"), MOST_ROWS))
                t.groups[-1][-1].append(t.cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in MUTE:
            self.mute = max(0, self.mute - 1)
        elif tag in ("h1", "h2", "h3", "h4"):
            self.in_heading = False
        elif self.open:
            t = self.open[-1]
            if tag == "table":
                self.open.pop()
            elif tag == "caption":
                t.in_caption = False
            elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                t.cell = None

    def handle_data(self, data: str) -> None:
        if self.mute:
            return
        if self.open:
            t = self.open[-1]
            if t.in_caption:
                t.caption.append(data)
            elif t.cell is not None:
                t.cell.words.append(data)
        elif self.in_heading:
            self.heading.append(data)


def tables_of(html: str | None) -> list[Table]:
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    return walk.tables


def grid(table: Table) -> list[dict[int, Spot]]:
    """The rows of the grid: column to spot."""
    out: list[dict[int, Spot]] = []
    for group in table.groups:
        hanging: dict[int, tuple[int, Spot]] = {}  # column: rows still covered
        for nth, cells in enumerate(group):
            row = {c: Spot(s.text, s.header, True, s.from_left) for c, (_, s) in hanging.items()}
            hanging = {c: (n - 1, s) for c, (n, s) in hanging.items() if n > 1}
            at = 0
            for cell in cells:
                while at in row:
                    at += 1
                rows = cell.rows or len(group) - nth
                for c in range(at, at + cell.columns):
                    if c in row:  # a cell from above stands in the way
                        break
                    row[c] = Spot(cell.text, cell.header, False, c > at)
                    if rows > 1:
                        hanging[c] = (rows - 1, row[c])
                at += cell.columns
            out.append(row)
    return out


def _mapped(pages: DataFrame, key: str, html: str, fields: list[tuple[str, T.DataType]], rows_of) -> DataFrame:
    """(key, *fields): rows_of(html) gives the fields of each row."""
    kinds = [pages.schema[key].dataType, *(k for _, k in fields)]
    names = [key, *(n for n, _ in fields)]
    simple = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = rows_of(page)
                if rows:
                    columns = [pa.array([k] * len(rows), b.schema.field(0).type), *(pa.array([r[j] for r in rows], simple[kind]) for j, (_, kind) in enumerate(fields))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    ready(pages.sparkSession)
    return spread(pages.select(key, html)).mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]))


def cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_index, title, row, column, text, header): every place of every table's grid, from 0."""
    i, s = T.IntegerType(), T.StringType()
    fields = [("table_index", i), ("title", s), ("row", i), ("column", i), ("text", s), ("header", T.BooleanType())]
    return _mapped(pages, key, html, fields, lambda page: [(n, t.title, r, c, x.text, x.header) for n, t in enumerate(tables_of(page)) for r, row in enumerate(grid(t)) for c, x in sorted(row.items())])


def _named(heads: list[dict[int, Spot]], column: int) -> str:
    """A column's name: the texts of its header cells from top to bottom, each once."""
    return " / ".join(dict.fromkeys(h[column].text for h in heads if column in h and h[column].text))


def row_groups(table: Table, rows: int, most: int) -> list[tuple[int, int, str]]:
    """(first row, last row, text) of each group of body rows.

    Rows that a cell spans are a unit, cut after `most` rows; a unit belongs to the group that its first row's number among the body
    rows, divided by `rows`, names."""
    g = grid(table)
    n_heads = next((k for k, r in enumerate(g) if not r or not all(x.header for x in r.values())), len(g))
    heads, body = g[:n_heads], g[n_heads:]
    out: dict[int, list] = {}
    start = 0
    for k, row in enumerate(body):
        if not any(x.from_above for x in row.values()) or k - start >= most:
            start = k
        named = [(_named(heads, c), x.text) for c, x in sorted(row.items()) if x.text and not x.from_left]
        line = "; ".join(f"{name}: {text}" if name else text for name, text in named)
        one = out.setdefault(start // rows, [n_heads + k, 0, []])
        one[1] = n_heads + k
        one[2].append(line)
    return [(a, b, "\n".join(([table.title] if table.title else []) + lines)) for _, (a, b, lines) in sorted(out.items())]


def table_chunks(pages: DataFrame, key: str, html: str = "html", rows: int = 20, most: int = 60) -> DataFrame:
    """(key, table_index, group_index, first_row, last_row, content): groups of about `rows` rows with title and column names."""
    if not 0 < rows <= most:
        raise ValueError(f"groups of {rows} rows, units of {most}")
    i = T.IntegerType()
    fields = [("table_index", i), ("group_index", i), ("first_row", i), ("last_row", i), ("content", T.StringType())]
    return _mapped(pages, key, html, fields, lambda page: [(n, j, *x) for n, t in enumerate(tables_of(page)) for j, x in enumerate(row_groups(t, rows, most))])
