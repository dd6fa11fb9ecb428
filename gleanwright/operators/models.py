"""Models as columns: embedders, pair scorers and generators that the caller brings, loaded once in each worker.

`load` is a function without arguments that returns the model; it runs on the executors, on the first batch of a worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ready

PROMPT = "question:{} \n \n passage:{}"


def embed(load: Callable[[], Callable[[list[str]], list]], text: Column | str) -> Column:
    """A vector for each text; a null text counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for b in batches:
            yield pd.Series([list(map(float, v)) for v in model(b.fillna("").tolist())])

    return run(text)


def embed_pairs(load: Callable[[], Callable[[list[tuple[str, bytes]]], list]], text: Column | str, image: Column | str) -> Column:
    """A vector for each text and image (its bytes); a null text or image counts as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for t, i in batches:
            yield pd.Series([list(map(float, v)) for v in model([(a or "", bytes(b or b"")) for a, b in zip(t, i, strict=True)])])

    return run(text, image)


def score_pairs(load: Callable[[], Callable[[list[str]], list[float]]], query: Column | str, passage: Column | str, prompt: str = PROMPT) -> Column:
    """A relevance score for each query and passage, formatted by the prompt; null where either is missing or empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, p in batches:
            some = [bool(a and b) for a, b in zip(q, p, strict=True)]
            got = iter(model([prompt.format(a, b) for a, b, ok in zip(q, p, some, strict=True) if ok]))
            yield pd.Series([float(next(got)) if ok else None for ok in some], dtype="float64")

    return run(query, passage)


def generate(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], list[str]]], gate: Column, name: str = "answer", error: str | None = None) -> DataFrame:
    """rows with an answer where the gate is open; the model never sees the others. error names a column for failures: a batch that
    fails is asked row by row, and a row that fails has its error there and no answer. Without it a failure ends the job."""
    stay, flag = rows.columns, "_open"
    while flag in stay:
        flag = f"_{flag}"

    def asked(model, some: pd.DataFrame) -> list[tuple[str | None, str | None]]:
        try:
            return [(a, None) for a in model(some)]
        except Exception as e:
            if not error:
                raise
            return [(None, f"{type(e).__name__}: {e}")] if len(some) == 1 else [x for k in range(len(some)) for x in asked(model, some.iloc[k : k + 1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            is_open, own = b.column(flag), b.select(stay)
            got = iter(asked(model, own.filter(is_open).to_pandas()) if is_open.true_count else [])
            told = [next(got) if x else (None, None) for x in is_open.to_pylist()]
            new = [pa.array([t[k] for t in told], pa.string()) for k in range(1 + bool(error))]
            yield pa.RecordBatch.from_arrays([*own.columns, *new], names=[*stay, name, *([error] if error else [])])

    ready(rows.sparkSession)
    schema = rows.withColumns({c: F.lit(None).cast("string") for c in (name, *([error] if error else []))}).schema
    return rows.withColumn(flag, F.coalesce(gate, F.lit(False))).mapInArrow(run, schema)


def rename_keys(column: Column | str, prefixes: dict[str, str]) -> Column:
    """Names with the first prefix that fits replaced."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.when(F.lit(False), c)
    for old, new in prefixes.items():
        out = out.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, F.lit(len(old) + 1), F.length(c))))
    return out.otherwise(c)
