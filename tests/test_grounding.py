"""Answer measures against plain versions."""

import random
import re

import pytest

from gleanwright.operators import grounding

tok = lambda s: re.findall(r"[a-z0-9]+(?:[_-][a-z0-9]+)*", s.lower())


def covered(sentence, context, run):
    """Places of a sentence's tokens that lie in a run that the context has too."""
    n = min(len(sentence), run)
    there = {tuple(context[k : k + n]) for k in range(len(context) - n + 1)}
    return {p for k in range(len(sentence) - n + 1) if tuple(sentence[k : k + n]) in there for p in range(k, k + n)}


def plain(text, contexts, run):
    """(sentences, supported, recall, precision); contexts in rank order."""
    sentences = [t for t in map(tok, re.split(grounding.SENTENCE_END, text)) if t]
    each = [[covered(s, tok(c), run) for c in contexts] for s in sentences]
    ok = sum(2 * len(set().union(*e)) >= len(s) for s, e in zip(sentences, each, strict=True))
    useful = [r for r in range(len(contexts)) if any(e[r] and 2 * len(e[r]) >= len(s) for s, e in zip(sentences, each, strict=True))]
    precision = sum((k + 1) / (r + 1) for k, r in enumerate(useful)) / len(useful) if useful else 0.0
    return len(sentences), ok, ok / len(sentences), precision


@pytest.mark.parametrize("run", [4, 2])
def test_support_is_that_of_the_plain_version(spark, run):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(["Leaf", "rust", "corn", "rice", "spot", "soil", "the", "of", "in. It", "was!\nNow"], k=n))
    contexts = [(k, text(rng.randint(0, 40))) for k in range(12)]
    answers = [(k, text(rng.randint(0, 25)) + rng.choice(["", ". " + " ".join(rng.choice(contexts)[1].split()[2:12])])) for k in range(25)]
    pairs = [(a, c, r) for a, _ in answers for r, c in enumerate(rng.sample(range(12), 4), 1)]
    out = grounding.support(
        spark.createDataFrame([*answers, (98, ""), (99, None)], "answer_id int, text string"), spark.createDataFrame(pairs, "answer_id int, context_id int, rank int"), spark.createDataFrame([*contexts, (50, None)], "context_id int, text string"), run=run
    ).collect()
    want = {a: plain(t, [contexts[c][1] for x, c, _ in pairs if x == a], run) for a, t in answers if tok(t)}
    assert {r.answer_id: tuple(r)[1:] for r in out} == {a: pytest.approx(w) for a, w in want.items()}


def test_entity_recall(spark):
    answers = spark.createDataFrame([(1, "Northern Leaf in Iowa: 12.5 kg, 12.5 kg and Rust"), (2, "nothing here"), (3, "Corn 7"), (4, None)], "answer_id int, text string")
    contexts = spark.createDataFrame([(1, "Iowa: Northern Leaf spreads"), (1, "use 12.5"), (3, "corn 77"), (1, None)], "answer_id int, text string")
    assert {tuple(r) for r in grounding.entity_recall(answers, contexts).collect()} == {(1, 4, 3, 0.75), (3, 2, 0, 0.0)}
