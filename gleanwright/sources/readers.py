"""Readers: strict and lenient JSON lines, records with defaults, directories, results, registries."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..session import by_size, ready, written

KNOWN = ("knowledge_id", "source", "source_type", "crop", "disease", "evidence_type", "content", "title", "recommendation_preference", "organic_eligible", "ipm_eligible")
RESULTS = "image string, ground_truth string, prediction string, confidence string, truncated boolean, correct boolean, inference_time double, response string"

#: The comparison file of two models.
AB_RESULTS = "image string, ground_truth string, " + ", ".join(
    f"{m}_{c}" for m in ("base", "lora") for c in ("prediction string", "confidence string", "truncated boolean", "correct boolean", "inference_time double", "response string")
) + ", verdict string"


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_lenient(spark: SparkSession, path: str, schema: str, bad: str = "_corrupt") -> tuple[DataFrame, DataFrame]:
    """JSON lines and the lines that are none, both kept."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    broken = F.col("r").isNull() | F.col(f"r.{bad}").isNotNull()
    return parsed.filter(~broken).select("r.*").drop(bad), parsed.filter(broken).select(F.col("value").alias(bad))


#: Bytes of a line file that one task reads, if a caller says nothing else.
RANGE = "spark.sql.files.maxPartitionBytes"


class BadLine(ValueError):
    """A line that is no JSON object; the message names file and line."""


def numbered_lines(spark: SparkSession, path: str, range_bytes: int | None = None, pieces: bool = False) -> DataFrame:
    """(path, line_number, line) of line files of any size, blank lines counted but left out.
    pieces: the files of a folder, by name, are pieces of one that ends in a line feed each; numbers go on from piece to piece, and path is the folder.

    Spark cuts a file into byte ranges. Each range numbers its own lines while it is read; a second pass adds the lines of the ranges
    before it. Files are read once, since a later read could be cut otherwise. Lines end at a line feed; a carriage return before it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for b in batches:
            files, starts = b.column("path").to_pylist(), b.column("start").to_pylist()
            number = []
            for at in zip(files, starts, strict=True):
                seen[at] = seen.get(at, 0) + 1
                number.append(seen[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], names=[*b.schema.names, "nth"])

    ready(spark)
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.regexp_replace("value", "\r$", "").alias("line"))
    old = spark.conf.get(RANGE)
    spark.conf.set(RANGE, str(range_bytes) if range_bytes else old)
    try:
        rows = written(raw.mapInArrow(run, "path string, start long, line string, nth long"))
    finally:
        spark.conf.set(RANGE, old)
    whole = F.regexp_replace("path", "/[^/]*$", "") if pieces else F.col("path")
    before = Window.partitionBy(whole).orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n")).select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(by_size(starts), ["path", "start"]).filter(F.trim("line") != "").select(whole.alias("path"), (F.col("before") + F.col("nth")).alias("line_number"), "line")


def numbered_json(spark: SparkSession, path: str, schema: str, strict: bool = True, range_bytes: int | None = None, pieces: bool = False) -> tuple[DataFrame, DataFrame]:
    """JSON lines with (path, line_number), and the lines that are no objects, with theirs. strict: if there is any, the first by file and line is an error."""
    lines = numbered_lines(spark, path, range_bytes, pieces)
    parsed = lines.withColumn("r", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~F.trim("line").startswith("{")
    bad = parsed.filter(broken).select("path", "line_number", "line")
    if strict and (first := bad.orderBy("path", "line_number").first()):
        raise BadLine(f"{first.path}, line {first.line_number}: not a JSON object: {first.line[:200]}")
    return parsed.filter(~broken).select("path", "line_number", "r.*").drop("_corrupt"), bad


def external_records(lines: DataFrame, line: str = "line") -> DataFrame:
    """Numbered JSON lines as records: source "Unknown" and type "json" where a line names none; the line number stays."""
    get = lambda k: blank_to_null(F.element_at(F.from_json(line, "map<string,string>"), k))
    fields = [get(k).alias(k) for k in ("title", "crop", "disease", "content")]
    return lines.select(*(c for c in lines.columns if c != line), F.coalesce(get("source"), F.lit("Unknown")).alias("source"), F.coalesce(get("source_type"), F.lit("json")).alias("source_type"), *fields)


def source_pages(sources: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """The loaded pages of the registry's enabled sources, with their source."""
    return pages.join(by_size(sources.select("source_id", "grp", "name", "authority", F.col("url").alias(url))), url)


def fetched(sources: DataFrame, fetch, url: str = "url") -> DataFrame:
    """sources with `html`; fetch(url) -> text or None is the caller's, and a page that fails has its error in `error` and no html."""

    def run(frames):
        for p in frames:
            got, failed = [], []
            for u in p[url]:
                try:
                    got.append(fetch(u))
                    failed.append(None)
                except Exception as e:  # one page must not end the load
                    got.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield p.assign(html=got, error=failed)

    return sources.mapInPandas(run, T.StructType([*sources.schema.fields, T.StructField("html", T.StringType()), T.StructField("error", T.StringType())]))


def diagnosis_records(df: DataFrame, default_source: str = "dataset") -> DataFrame:
    """Label metadata as diagnosis records: content from the fields that are there."""
    say = lambda label, c: F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c)))
    content = F.concat_ws(". ", say("Crop", "crop"), say("Disease or condition", "disease"), say("Health status", "health_status"), say("Original label", "original_label"))
    source = F.coalesce("source", F.lit(default_source))
    return df.select(F.col("sample_id").cast("string").alias("knowledge_id"), source.alias("source"), F.lit("image_diagnosis_metadata").alias("source_type"), "crop", "disease", F.lit("diagnosis").alias("evidence_type"), content.alias("content"), F.concat(source, F.lit(" diagnosis evidence")).alias("title"))


def treatment_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON strings as treatment records with defaults; keys that are no fields go to `metadata`."""
    m = F.from_json(column, "map<string,string>")
    get = lambda k: F.element_at("m", k)
    flag = lambda k: F.coalesce(F.lower(get(k)) == "true", F.lit(False)).alias(k)
    return lines.withColumn("m", m).select(
        get("knowledge_id").alias("knowledge_id"), get("source").alias("source"), F.coalesce(get("source_type"), F.lit("agricultural_guidance")).alias("source_type"), get("crop").alias("crop"), get("disease").alias("disease"),
        F.coalesce(get("evidence_type"), F.lit("treatment")).alias("evidence_type"), get("content").alias("content"), get("title").alias("title"), F.coalesce(get("recommendation_preference"), F.lit("General")).alias("recommendation_preference"),
        flag("organic_eligible"), flag("ipm_eligible"), F.map_filter("m", lambda k, _: ~k.isin(*KNOWN)).alias("metadata"),
    )


def all_records(*parts: DataFrame) -> DataFrame:
    """One table of several sources; columns that one has not are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def image_paths(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(path, folder, name) of the image files below root, by path; contents are not read."""
    pattern = "*.{" + ",".join([*extensions, *(e.upper() for e in extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    parts = F.split("path", "/")
    return files.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name")).orderBy("path")


def pdf_pages(spark: SparkSession, path: str, page_texts) -> DataFrame:
    """(path, page, text) of non-empty pages; page_texts(bytes) -> list of texts is the caller's PDF reader."""

    def run(frames):
        import pandas as pd

        for p in frames:
            rows = [(x, i, s) for x, c in zip(p["path"], p["content"], strict=True) for i, s in enumerate(page_texts(bytes(c)), 1) if s and s.strip()]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def results_csv(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Evaluation rows from CSV with quoted line breaks; an unreadable path gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """Sources of a YAML registry that are enabled at each of three levels: the whole, their group, and themselves."""
    conf = yaml.safe_load(Path(path).read_text()) or {}
    on = lambda d: isinstance(d, dict) and d.get("enabled", True)
    rows = []
    if on(conf):
        for name, group in conf.items():
            for s in (group.get("sources") or []) if isinstance(group, dict) and on(group) else []:
                if on(s):
                    rows.append((name, s.get("source_id"), s.get("name"), s.get("url"), s.get("authority"), bool(s.get("verify_ssl", True))))
    return spark.createDataFrame(rows, "grp string, source_id string, name string, url string, authority string, verify_ssl boolean")


def index(spark: SparkSession, path: str, key: str = "chunk_id", vectors: str = "vector") -> DataFrame:
    """A stored index, checked: each row has its vector beside it, and ids are unique."""
    df = spark.read.parquet(path)
    bad = df.agg(F.count_if(F.col(vectors).isNull()).alias("a"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("b")).first()
    if bad.a or bad.b:
        raise ValueError(f"index at {path}: {bad.a} rows without vector, {bad.b} repeated ids")
    return df
