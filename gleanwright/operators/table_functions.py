"""Table functions for SQL: sections of pages and packed chunks of texts, by lateral join or over partitioned tables.

They give the rows of `html.sections` (before its ids) and `chunking.chunk_pack`, for users who write SQL:

    SELECT page_id, s.* FROM pages, LATERAL page_sections(html) s
    SELECT key, c.* FROM docs, LATERAL packed_chunks(content, 650, 100, 800, 120) c
    SELECT * FROM packed_lines(TABLE(lines), 'key', 'position', 'line')

packed_lines takes a text as rows, one a line; it asks Spark to bring the rows of a key together in order, so a text may come in
parts, and holds one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..session import ready
from .chunking import check_sizes, pack_text
from .html import section_rows

SECTIONS = "counter int, section string, subsection string, content string"
CHUNK = [T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("content", T.StringType())]


class PageSections:
    """The text under each heading of a page."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        yield from section_rows(html or "")


class PackedChunks:
    """Packed chunks of a text; sizes as for chunking.pack_text, checked while the query is planned where they are constants."""

    @staticmethod
    def analyze(text: AnalyzeArgument, target: AnalyzeArgument, overlap: AnalyzeArgument, most: AnalyzeArgument, least: AnalyzeArgument) -> AnalyzeResult:
        sizes = [x.value for x in (target, overlap, most, least)]
        if all(x.isConstantExpression for x in (target, overlap, most, least)):
            check_sizes(*sizes)
        return AnalyzeResult(T.StructType(CHUNK))

    def eval(self, text: str | None, target: int, overlap: int, most: int, least: int) -> Iterator[tuple]:
        chunks = pack_text(text, target, overlap, most, least)
        for k, c in enumerate(chunks):
            yield k, len(chunks), " ".join(c)


class PackedLines:
    """Packed chunks of texts that are tables of lines: (key, chunk_index, total_chunks, content)."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, position: AnalyzeArgument, line: AnalyzeArgument) -> AnalyzeResult:
        names = [x.value for x in (key, position, line)]
        for n in names:
            if n not in rows.dataType.names:
                raise ValueError(f"no column {n} in {rows.dataType.names}")
        kind = rows.dataType[names[0]].dataType
        return AnalyzeResult(T.StructType([T.StructField(names[0], kind), *CHUNK]), partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self) -> None:
        self.key = None
        self.lines: list[str] = []

    def eval(self, row: Row, key: str, position: str, line: str) -> None:
        self.key = row[key]
        if row[line] is not None:
            self.lines.append(row[line])

    def terminate(self) -> Iterator[tuple]:
        chunks = pack_text("\n".join(self.lines))
        for k, c in enumerate(chunks):
            yield self.key, k, len(chunks), " ".join(c)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as page_sections, packed_chunks and packed_lines."""
    ready(spark)
    spark.udtf.register("page_sections", udtf(PageSections, returnType=SECTIONS))
    spark.udtf.register("packed_chunks", udtf(PackedChunks))
    spark.udtf.register("packed_lines", udtf(PackedLines))
