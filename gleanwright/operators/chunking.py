"""Chunks of texts: token windows as plain functions, and structure-aware packing, which is a fold over the blocks of one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coalesce_blank, words
from ..session import ready, spread

MARKER = re.compile(r"(?:[-*•]|\d+[.)]|[A-Za-z][.)])\s+")


def check_sizes(target: int, overlap: int, most: int, least: int) -> None:
    if not (0 < target <= most and 0 <= overlap < most and 0 <= least <= most):
        raise ValueError(f"chunk sizes do not fit: target {target}, overlap {overlap}, max {most}, min {least}")


def windows(tokens: Column, size: int = 800, overlap: int = 100) -> Column:
    """Windows of a token array; the last one ends where the tokens end."""
    step, n = size - overlap, F.size(tokens)
    last = F.greatest(F.ceil((n - size) / step) * step, F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda s: F.struct(s.alias("start"), F.slice(tokens, s + 1, size).alias("tokens")))).otherwise(F.array())


def chunk_windows(records: DataFrame, key: str = "knowledge_id", text: str = "content", size: int = 800, overlap: int = 100) -> DataFrame:
    """(key, chunk_index, total_chunks, start, tokens): each text's windows."""
    w = records.select(key, words(text).alias("tk")).filter(F.size("tk") > 0).select(key, windows(F.col("tk"), size, overlap).alias("w"))
    return w.select(key, F.size("w").alias("total_chunks"), F.posexplode("w").alias("chunk_index", "c")).select(key, "chunk_index", "total_chunks", "c.start", "c.tokens")


def blocks_of(text: str) -> list[list[str]]:
    """Structural blocks of a text as token lists."""
    out = []
    for para in re.split(r"\n\s*\n+", text.strip()):
        lines = [x.strip() for x in para.strip().split("\n") if x.strip()]
        starts = [i for i, line in enumerate(lines) if not i or MARKER.match(line)]
        out += [" ".join(lines[a:b]).split() for a, b in zip(starts, [*starts[1:], len(lines)], strict=False)]
    return [b for b in out if b]


def pack_text(text: str | None, target: int = 650, overlap: int = 100, most: int = 800, least: int = 120, parity: bool = True) -> list[list[str]]:
    """Blocks packed greedily to `target` tokens, each chunk opened by the last `overlap` of the one before, a small tail merged.
    A block over `most` is cut into windows first; with parity=False its windows, which overlap already, take no second overlap."""
    units: list[tuple[list[str], bool]] = []
    for block in blocks_of(text or ""):
        step = most - overlap
        cuts = range(0, max(len(block) - most + step - 1, 0) // step * step + 1, step) if len(block) > most else [0]
        units += [(block[s : s + most], bool(s)) for s in cuts]
    chunks: list[list[str]] = []
    now: list[str] = []
    for tokens, continued in units:
        if not now or len(now) + len(tokens) <= target:
            now = now + tokens
            continue
        chunks.append(now)
        carry = now[-overlap:] if overlap and (parity or not continued) else []
        now = carry + tokens
        if len(now) > most:
            chunks.append(now[:most])
            now = now[most - overlap :]
    if now:
        chunks.append(now)
    merged: list[list[str]] = []
    for c in chunks:
        if merged and len(c) < least and len(merged[-1]) + len(c) <= most:
            merged[-1] = merged[-1] + c
        else:
            merged.append(c)
    return merged


def chunk_pack(records: DataFrame, key: str = "knowledge_id", text: str = "content", **sizes) -> DataFrame:
    """(key, chunk_index, total_chunks, content): packed chunks of each text; a text without words has none."""
    check_sizes(sizes.get("target", 650), sizes.get("overlap", 100), sizes.get("most", 800), sizes.get("least", 120))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, len(cs), " ".join(c)) for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for cs in [pack_text(x, **sizes)] for i, c in enumerate(cs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((b.schema.field(0).type, pa.int32(), pa.int32(), pa.string()))], names=[key, "chunk_index", "total_chunks", "content"])

    ready(records.sparkSession)
    kind = records.schema[key]
    return spread(records.select(key, text)).mapInArrow(run, T.StructType([kind, T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType()), T.StructField("content", T.StringType())]))


def chunk_id(key: Column | str, index: Column | str) -> Column:
    return F.format_string("%s::chunk-%04d", key, index)


def _line(name: str, c: Column | str) -> Column:
    """`name: value`, or null for a missing or empty value, which concat_ws leaves out."""
    return F.when(coalesce_blank(c).isNotNull(), F.concat(F.lit(f"{name}: "), c if isinstance(c, Column) else F.col(c)))


def _flag(name: str, c: str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit(False)).cast("string"))


def retrieval_text(title: str | None = None, health: str | None = None, original: str | None = None, chunk: tuple[str, str] | None = None) -> Column:
    """The text that stands for a record, or with chunk=(index, total) for a chunk; other fields by evidence type."""
    none = F.lit(None).cast("string")
    opt = lambda name, c: _line(name, c) if c else none
    part = F.concat(F.lit("Chunk: "), (F.col(chunk[0]) + 1).cast("string"), F.lit("/"), F.col(chunk[1]).cast("string")) if chunk else none
    kind = F.concat(F.lit("Evidence type: "), F.col("evidence_type"))
    head = [F.concat(F.lit("Source: "), F.col("source")), kind, _line("Crop", "crop"), _line("Disease", "disease")]
    text = _line("Content", "content")
    diagnosis = F.concat_ws("\n", *head, *([part, text] if chunk else [opt("Health status", health), opt("Original label", original)]))
    treatment = F.concat_ws("\n", *head, _line("Recommendation preference", "recommendation_preference"), _flag("Organic eligible", "organic_eligible"), _flag("IPM eligible", "ipm_eligible"), opt("Title", title), part, text)
    return F.when(F.col("evidence_type") == "diagnosis", diagnosis).when(F.col("evidence_type") == "treatment", treatment).otherwise(F.concat_ws("\n", *head, opt("Title", title), text))


def metadata_map(own: Column | None, *canonical: str) -> Column:
    """A map of the canonical columns over a record's own map; canonical keys win."""
    top = F.create_map(*(x for c in canonical for x in (F.lit(c), F.col(c).cast("string"))))
    return top if own is None else F.map_concat(F.map_filter(own, lambda k, _: ~k.isin(*canonical)), top)
