"""Queries over tables in pages. The driver's pages hold none, so part is rendered as pages with one table for each 40 parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables as t
from ..operators import grids
from .registry import query

#: Rows of a table by type and key; a type's first row has the cell that spans all of them, and every fifth size has a name over two columns.
ROWS = """rows AS (SELECT p_partkey // 40 AS page, p_type, p_name, p_size, p_partkey, row_number() OVER (PARTITION BY p_partkey // 40 ORDER BY p_type, p_partkey) - 1 AS r FROM part),
spans AS (SELECT *, min(r) OVER (PARTITION BY page, p_type) AS unit FROM rows)"""
HEADS = "(VALUES (0, 0, 'Type'), (0, 1, 'Part'), (0, 2, 'Part'), (1, 0, 'Type'), (1, 1, 'Name'), (1, 2, 'Size')) h(\"row\", \"column\", text)"


def pages(spark: SparkSession, sf: str) -> DataFrame:
    p = t.load(spark, sf, "part").withColumn("page", F.floor(F.col("p_partkey") / 40))
    own = Window.partitionBy("page", "p_type")  # 40 rows at most
    p = p.withColumns({"n": F.count(F.lit(1)).over(own), "nth": F.row_number().over(own.orderBy("p_partkey"))})
    kind = F.when(F.col("nth") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), "p_type", F.lit("</td>"))).otherwise("")
    name = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("<td colspan=2>"), "p_name")).otherwise(F.concat(F.lit("<td>"), "p_name", F.lit("<td>"), F.col("p_size").cast("string"), F.lit("</td>")))
    row = F.struct("p_type", "p_partkey", F.concat(F.lit("<tr>"), kind, name, F.lit("</tr>")).alias("html"))
    body = p.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["html"]), "\n").alias("body"))
    head = F.concat(F.lit("<h2>Parts</h2><table><caption>Parts "), F.col("page").cast("string"), F.lit("</caption><thead><tr><th rowspan=2>Type</th><th colspan='2'>Part</th></tr><tr><th>Name<th>Size</tr></thead><tbody>"))
    return body.select("page", F.concat(head, "body", F.lit("</tbody></table>")).alias("html"))


@query(
    "table_cells",
    f"""WITH {ROWS} SELECT page, 0 AS table_index, 'Parts ' || page AS title, "row", "column", text, true AS header FROM (SELECT DISTINCT page FROM rows), {HEADS}
UNION ALL SELECT page, 0, 'Parts ' || page, (r + 2)::INT, c, CASE c WHEN 0 THEN p_type WHEN 1 THEN p_name ELSE CASE WHEN p_size % 5 = 0 THEN p_name ELSE p_size::VARCHAR END END, false FROM rows, (VALUES (0), (1), (2)) v(c)""",
)
def table_cells(spark: SparkSession, sf: str) -> DataFrame:
    return grids.cells(pages(spark, sf), "page")


@query(
    "table_chunks",
    f"""WITH {ROWS}, lines AS (SELECT page, unit // 8 AS g, r, 'Type: ' || p_type || '; Part / Name: ' || p_name || CASE WHEN p_size % 5 = 0 THEN '' ELSE '; Part / Size: ' || p_size END AS line FROM spans)
SELECT page, 0 AS table_index, (row_number() OVER (PARTITION BY page ORDER BY g) - 1)::INT AS group_index, (min(r) + 2)::INT AS first_row, (max(r) + 2)::INT AS last_row, 'Parts ' || page || chr(10) || string_agg(line, chr(10) ORDER BY r) AS content FROM lines GROUP BY page, g""",
)
def table_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return grids.table_chunks(pages(spark, sf), "page", rows=8)
