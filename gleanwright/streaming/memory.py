"""Two layers of memory for a stream of turns: the current case, and the profile of whom it is about.

A turn may name a crop, a condition and a place, which belong to the current case, and a home and a preference, which belong to the
profile and stay. A turn that names another crop than the case's starts a new case that knows nothing of the old one; so does a turn
after more than `gap` of silence, and a case that stays silent so long is closed with a row of its own. What is known at a turn is
the turn itself, then the case, then the profile, then defaults.

Turns may come out of order. They wait in state until the watermark says that no earlier one can come, and are then taken by time
and sequence number, so results do not depend on how the stream is cut into batches, or where it is stopped and started again.
State is kept for each group of cases: a table with one row of memory a case, and tables of the turns within the watermark's delay.
Cases are dealt into GROUPS groups by hash, since a call and its messages to the state store cost the same for one case as for many.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..session import ready

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: What is assumed where nothing is known.
NO_PLACE, NO_PREFERENCE = "unknown", "General"
TURN = "at long, seq long, crop string, disease string, place string, home string, preference string"
CONTEXT = "case long, at long, seq long, kind string, number int, crop string, disease string, place string, preference string"


#: Groups of cases with a state of their own. A checkpoint goes on only with the number it was begun with.
GROUPS = 256
WORDS = [(c, pa.string()) for c in ("crop", "disease", "place", "home", "preference")]
WAITING = pa.schema([("case", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), *WORDS])
KNOWN = pa.schema([("case", pa.string()), ("number", pa.int32()), ("open", pa.bool_()), ("last", pa.int64()), *WORDS])


def _pack(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _open(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _rows(table: pa.Table) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns), strict=True)


class CaseMemory(StatefulProcessor):
    """Rows of CONTEXT: one of kind `turn` for each turn, one of kind `closed` for each case that fell silent. gap: in microseconds.
    The key is a group of cases; `case` comes as a string, which pandas keeps exact beside nulls."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "cases binary")
        self.waiting = handle.getListState("waiting", "turns binary")
        self.told: set[tuple] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [pa.Table.from_pandas(p[WAITING.names], WAITING, preserve_index=False) for p in rows if len(p)]
        if came:
            turns = pa.concat_tables(came)
            self.waiting.appendValue((_pack(turns),))
            self.handle.registerTimer(pc.min(turns["at"]).as_py() // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs() * 1000
        if (key, until) in self.told:  # by an earlier timer of the group
            yield pd.DataFrame()
            return
        self.told.add((key, until))
        turns = pa.concat_tables([WAITING.empty_table(), *(_open(t[0]) for t in self.waiting.get())])
        late = pc.greater(turns["at"], until)
        due, left = turns.filter(pc.invert(late)).sort_by([("at", "ascending"), ("seq", "ascending")]), turns.filter(late)
        known = {case: m for case, *m in _rows(_open(self.memory.get()[0]))} if self.memory.exists() else {}
        out = []

        def told(case: str | None, m: list, at: int, seq: int | None, kind: str) -> None:
            out.append((None if case is None else int(case), at, seq, kind, m[0], m[3], m[4], m[5] or m[6] or NO_PLACE, m[7] or NO_PREFERENCE))

        def close(case: str | None, m: list, now: int) -> None:
            """End the case if it has been silent for longer than the gap by now."""
            if m[1] and now - m[2] > self.gap:
                told(case, m, m[2] + self.gap, None, "closed")
                m[1] = False

        for case, at, seq, crop, disease, place, home, preference in _rows(due):
            if (m := known.get(case)) is None:
                m = known[case] = [0, False, 0, None, None, None, None, None]
            close(case, m, at)
            if not m[1] or (crop and m[3] and crop != m[3]):
                m[0], m[1], m[3], m[4], m[5] = m[0] + 1, True, None, None, None
            m[2], m[3], m[4], m[5] = at, crop or m[3], disease or m[4], place or m[5]
            m[6], m[7] = home or m[6], preference or m[7]
            told(case, m, at, seq, "turn")
        for case, m in known.items():
            close(case, m, until)
        if out:
            columns = [list(known), *zip(*known.values(), strict=True)]
            self.memory.update((_pack(pa.table([pa.array(c, f.type) for c, f in zip(columns, KNOWN, strict=True)], schema=KNOWN)),))
        if due.num_rows:
            if left.num_rows:
                self.waiting.put([(_pack(left),)])
            else:
                self.waiting.clear()
        times = [m[2] + self.gap for m in known.values() if m[1]] + ([pc.min(left["at"]).as_py()] if left.num_rows else [])
        if times:
            self.handle.registerTimer(max(min(times), until) // 1000 + 1)
        frame = pd.DataFrame(out, columns=["case", "at", "seq", "kind", "number", "crop", "disease", "place", "preference"])
        yield frame.astype({"case": "Int64", "seq": "Int64", "number": "int32"}) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def contexts(turns: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """CONTEXT rows of a stream of turns: case long and the columns of TURN, `at` in microseconds; delay: how late a turn may come."""
    ready(turns.sparkSession)
    timed = turns.withColumn("_time", F.timestamp_micros("at")).withWatermark("_time", delay)
    dealt = timed.withColumns({"_group": F.pmod(F.xxhash64("case"), F.lit(GROUPS)), "case": F.col("case").cast("string")})
    return dealt.groupBy("_group").transformWithStateInPandas(CaseMemory(gap_seconds * 1_000_000), CONTEXT, "Append", "eventTime")


@contextmanager
def stateful(spark: SparkSession):
    """The state store that such streams need, for as long as one is started."""
    old = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, old)


def remember(spark: SparkSession, source: str, sink: str, checkpoint: str, gap_seconds: int, delay: str, files: int = 1) -> StreamingQuery:
    """Take all files of turns that are in `source` and not yet taken, `files` files a batch, append their contexts to `sink`, and end; the ended query."""
    stream = spark.readStream.schema(f"case long, {TURN}").option("maxFilesPerTrigger", files).parquet(source)
    with stateful(spark):
        query = contexts(stream, gap_seconds, delay).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query
