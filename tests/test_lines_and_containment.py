"""Numbered lines over many ranges, strict errors, containment against the loop over all pairs, and streams that stop and start."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleanwright.operators import containment, curation
from gleanwright.session import temporary
from gleanwright.sources import readers
from gleanwright.streaming import memory, resume


def local(spark, kind="test"):
    return temporary(spark, kind).removeprefix("file://")


def test_lines_of_a_file_over_many_ranges(spark, tmp_path):
    rng = random.Random(3)
    lines = [rng.choice(["", "  ", json.dumps({"a": k, "b": "é" * rng.randint(0, 60)})]) for k in range(3000)]
    (tmp_path / "one.jsonl").write_bytes("\n".join(lines).encode() + b"\n")
    (tmp_path / "two.jsonl").write_bytes(b'\r\n{"a": 1}\r\n{"a": 2}')
    rows = readers.numbered_lines(spark, str(tmp_path), range_bytes=700)
    got = {(r.path.rsplit("/", 1)[1], r.line_number): r.line for r in rows.collect()}
    want = {("one.jsonl", k): x for k, x in enumerate(lines, 1) if x.strip()} | {("two.jsonl", 2): '{"a": 1}', ("two.jsonl", 3): '{"a": 2}'}
    assert got == want
    good, bad = readers.numbered_json(spark, str(tmp_path), "a long, b string", range_bytes=700)
    assert good.count() == len(want) and bad.isEmpty()


def test_strict_errors_name_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{"a": \n[1, 2]\n')
    with pytest.raises(readers.BadLine, match=r"a\.jsonl, line 4: not a JSON object"):
        readers.numbered_json(spark, str(tmp_path), "a long")
    good, bad = readers.numbered_json(spark, str(tmp_path), "a long", strict=False)
    assert sorted((r.line_number, r.a) for r in good.collect()) == [(1, 1), (3, 2)]
    assert sorted((r.line_number, r.line) for r in bad.collect()) == [(4, '{"a": '), (5, "[1, 2]")]


def test_containment_is_that_of_the_loop(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choices("abcé_", k=n))
    texts = [word(rng.randint(0, 12)) for _ in range(200)] + [None, "", "%", "a%b", "a_b", "A"]
    patterns = [word(rng.randint(0, 5)) for _ in range(120)] + [None, "", "%", "_", "abcé_abcé_abcé_"]
    frame = lambda x, c: spark.createDataFrame([(v,) for v in x], f"{c} string")
    got = {tuple(r) for r in containment.holding(frame(texts, "t"), frame(patterns, "p")).collect()}
    assert got == {(t, p) for t in texts if t for p in patterns if p and p in t}
    assert containment.holding(frame([], "t"), frame(patterns, "p")).count() == 0


def test_a_hundred_thousand_aliases(spark):
    aliases = spark.range(100_000).select(F.concat(F.lit("alias"), F.format_string("%06d", "id"), F.lit("x")).alias("p"))
    texts = spark.range(0, 100_000, 50).select(F.concat(F.lit("see alias"), F.format_string("%06d", "id"), F.lit("x there")).alias("t"))
    found = containment.holding(texts, aliases)
    assert found.count() == 2000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_plans_of_label_joins_have_no_loop(spark):
    pairs = spark.createDataFrame([("Corn", "leaf_rust")], "crop string, disease string")
    mapping = spark.createDataFrame([("1", "corn", "rust", "rust")], "ord string, crop string, canonical string, alias string")
    folders = curation.class_folders(pairs.select(F.col("crop").alias("target")), pairs.select(F.col("disease").alias("folder")))
    for df in (curation.normalize_labels(pairs, mapping), folders):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def plain_contexts(turns, gap):
    out, state = set(), {}
    for case, at, seq, crop, disease, place, home, preference in sorted(turns, key=lambda t: (t[0], t[1], t[2])):
        m = state.setdefault(case, {"n": 0, "open": False, "last": 0, "crop": None, "disease": None, "place": None, "home": None, "preference": None})
        told = lambda at, seq, kind, m=m, case=case: out.add((case, at, seq, kind, m["n"], m["crop"], m["disease"], m["place"] or m["home"] or "unknown", m["preference"] or "General"))
        if m["open"] and at - m["last"] > gap:
            told(m["last"] + gap, None, "closed")
            m["open"] = False
        if not m["open"] or (crop and m["crop"] and crop != m["crop"]):
            m |= {"n": m["n"] + 1, "open": True, "crop": None, "disease": None, "place": None}
        m |= {"last": at, "crop": crop or m["crop"], "disease": disease or m["disease"], "place": place or m["place"], "home": home or m["home"], "preference": preference or m["preference"]}
        told(at, seq, "turn")
    for case, m in state.items():
        if m["open"]:
            out.add((case, m["last"] + gap, None, "closed", m["n"], m["crop"], m["disease"], m["place"] or m["home"] or "unknown", m["preference"] or "General"))
    return out


def test_case_memory_out_of_order_and_started_again(spark):
    rng, second = random.Random(4), 1_000_000
    some = lambda *x: rng.choice([None, None, *x])
    turns = [(rng.randrange(4), rng.randrange(0, 4000) * second, k, some("corn", "rice"), some("rust", "spot"), some("north"), some("farm"), some("IPM", "Organic")) for k in range(160)]
    base = local(spark)
    turns.sort(key=lambda t: t[1] + rng.choice([0, 0, 500]) * second)  # up to 500 seconds late
    frame = lambda rows: spark.createDataFrame(rows, f"case long, {memory.TURN}").coalesce(1)
    for k in range(4):
        frame(turns[k * 40 : k * 40 + 40]).write.mode("append").parquet(f"{base}/in")
        if k in (1, 3):
            if k == 3:
                frame([(99, 10**12, 0, None, None, None, None, None)]).write.mode("append").parquet(f"{base}/in")
            memory.remember(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", 300, "1500 seconds")
    rows = spark.read.schema(memory.CONTEXT).parquet(f"{base}/out").filter("case < 99").collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == plain_contexts(turns, 300 * second)


@pytest.mark.parametrize("dies_at", [0, 1])
def test_a_batch_that_is_written_twice_counts_once(spark, dies_at):
    base, died = local(spark), []
    for k in range(3):
        spark.createDataFrame(pd.DataFrame({"id": [k, k + 1, 10 + k], "v": ["a", "b", "c"]})).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def die(number):
        if number == dies_at and not died:
            died.append(number)
            raise RuntimeError("power cut")

    run = lambda hook: resume.process_batches(spark, f"{base}/in", "id long, v string", "id", lambda d: d.withColumn("v", F.upper("v")), f"{base}/out", f"{base}/checkpoint", after_write=hook)
    assert resume.results(spark, f"{base}/out") is None
    with pytest.raises(Exception, match="power cut"):
        run(die)
    assert died and resume.results(spark, f"{base}/out").count() == (3 if dies_at == 0 else 5)
    run(None)
    run(None)
    assert sorted(r.id for r in resume.results(spark, f"{base}/out").collect()) == [0, 1, 2, 3, 10, 11, 12]
