"""Personal data: base patterns against plain ones, the field's decoding against plain Viterbi, held-out accuracy."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from gleanwright.llm import crf, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def right(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t) if right(k, m[0])]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@", "mail.org", ".", "-", "_", "%", "+", "+1", "(", ")", " ", "1", "23", "255", "256", "007", "4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "٣", "é", "\n", "127.0.0.1", "1.2.3.4.5.6.7.8", "555-7163", "٤@x.y", "²"]
    for _ in range(30_000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1 " * 200_000, "1." * 200_000, "a@" * 200_000, "+1(" * 100_000 + "(" * 100_000, "a.b" * 100_000 + "@"])
def test_long_runs_take_no_square_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 5


def slow_labels(field, t, caution):
    """Viterbi by its formula, sequence by sequence."""
    word, ends, out = field.known(t.word), np.append(t.begins[1:], len(t.start)), []
    for b, e in zip(t.begins, ends, strict=True):
        score = np.zeros((e - b, len(field.labels)))
        for k in range(e - b):
            for o in range(-crf.REACH, crf.REACH + 1):
                inside = 0 <= k + o < e - b
                score[k] += field.shape[o + crf.REACH][t.shape[b + k + o] if inside else 0].astype(float) + field.word[o + crf.REACH][word[b + k + o] if inside else 0]
        score[:, 0] += caution
        best, back = score[0] + [crf.NEVER if x[0] == "I" else 0 for x in field.labels], []
        for k in range(1, e - b):
            reach = best[:, None] + field.pair
            back.append(reach.argmax(0))
            best = reach.max(0) + score[k]
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        out += reversed(path)
    return out


@pytest.mark.parametrize("caution", [1.0, 0.0, -3.0])
def test_labels_are_those_of_plain_viterbi(caution):
    field = pii.default_field()
    t, _ = crf.tagged(pii.labelled_table(400, 5), field.labels)
    assert field.decode(t, caution).tolist() == slow_labels(field, t, caution)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    labels = crf.labels_of(["x"])
    first = np.array([crf.NEVER if k.startswith("I-") else 0.0 for k in labels])
    there = np.array([[True, True, True], [True, True, False]])
    shape, word = rng.integers(0, 4, (5, 2, 3)), rng.integers(0, 3, (5, 2, 3))
    gold = np.array([[1, 2, 0], [0, 1, 0]])
    w = [rng.normal(size=(5, 4, 3)), rng.normal(size=(5, 3, 3)), rng.normal(size=(3, 3))]

    def loss():
        total = 0.0
        for n in range(2):
            size = int(there[n].sum())
            e = np.array([sum(w[0][o][shape[o, n, k]] + w[1][o][word[o, n, k]] for o in range(5)) for k in range(size)])
            e[0] += first
            score = lambda p, e=e: sum(e[k, y] for k, y in enumerate(p)) + sum(w[2][a, b] for a, b in zip(p, p[1:], strict=False))
            paths = [(a, b, c)[:size] for a in range(3) for b in range(3) for c in range(3)] if size == 3 else [(a, b) for a in range(3) for b in range(3)]
            total += np.log(sum(np.exp(score(p)) for p in paths)) - score(tuple(gold[n, :size]))
        return total

    grad = crf._gradient(w, there, shape, word, gold, first)
    for k, at in ((0, (2, 1, 1)), (0, (1, 3, 2)), (1, (2, 2, 0)), (2, (1, 2)), (2, (0, 1))):
        keep = w[k][at]
        w[k][at] = keep + 1e-5
        up = loss()
        w[k][at] = keep - 1e-5
        down = loss()
        w[k][at] = keep
        assert grad[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_held_out_accuracy():
    rows, field = pii.labelled_table(1500, 77), pii.default_field()
    hit = told = true = 0
    for (text, spans), got in zip(rows, pii.find(pa.array([t for t, _ in rows]), field), strict=True):
        base = pii.base_spans(text)
        want = {x for x in spans if not any(s < x[2] and x[1] < e for _, s, e in base)}
        got = {x for x in got if x[0] in pii.LEARNED}
        hit, told, true = hit + len(got & want), told + len(got), true + len(want)
    assert hit / told > 0.95 and hit / true > 0.88


def test_scan(spark):
    data = [
        (1, "Ünser: Please contact Anna Smith for details. ana@mail.org, 10.0.0.1", "s"), (2, "Call me at 482-555-7163. +1 (482) 555-7163", "s"), (3, None, None), (4, "", "s"),
        (1, "Ünser: Please contact Anna Smith for details. ana@mail.org, 10.0.0.1", "s"), (None, "card 4111 1111 1111 1111\n" + "the stone of the road. " * 30_000, "s"),
    ]
    df = spark.createDataFrame(data, "doc_id int, text string, spans string")
    out = pii.scan(df)
    assert out.columns == ["doc_id", "text", "spans", "_spans"]
    got = {r.doc_id: [tuple(x) for x in r._spans] for r in out.collect()}
    assert got == {
        1: [("person", 22, 32), ("email", 46, 58), ("ip", 60, 68)], 2: [("tel", 11, 23), ("phone", 25, 42)], 3: [], 4: [], None: [("card", 5, 24)],
    }
    assert pii.scan(df.limit(0)).count() == 0
    row = pii.scan(df.filter("doc_id = 2")).select(pii.joined("_spans").alias("a"), pii.joined("_spans", True).alias("b")).first()
    assert row == ("tel:11:23,phone:25:42", "phone:25:42")
