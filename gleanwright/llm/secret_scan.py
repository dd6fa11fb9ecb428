"""Secrets in whole texts: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assignments to telling names, access keys and long hexadecimal runs. Beside them, every unbroken run of at
least MIN_RUN key characters (dots and hyphens inside count) is scored by a first-order Markov model of random strings and one of
ordinary identifiers, both trained from labelled samples; a run whose ratio passes the threshold is a span of kind `markov`. Of a
run that patterns' spans cover in part, what they leave is scored. The threshold is a high quantile of the ratios of held-out
ordinary samples, plus a margin.

Defined cases: a null or empty text has no spans; a very long text is scanned whole, in time that grows with its length; repeated
rows are scanned one by one; an empty table stays empty; other columns pass unchanged, and a new one whose name is taken gets an
underscore in front.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import added
from .common import fresh, ready, texts

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 20
RUN = re.compile(rf"(?=[A-Za-z0-9+/_.-]{{{MIN_RUN}}})[A-Za-z0-9+/_.-]+={{0,2}}")
QUANTILE, MARGIN = 0.999, 2.0
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

#: Ordinary words that names in code, paths and prose are made of.
WORDS = """account action address and array async author available back base batch between block buffer build cache call category change channel
check class client close code column command comment common config connect content context copy count create current data date default
delete description device directory document download edit element enable error event example execute export field file filter find first
format frame from function general generate group handler header height hidden history image import index information input install
international interface item join key language last level library line list load local location logger main manager message method model module
name network node number object option order output package page parameter parent password path pattern person point position process product
profile project property provider query queue random range read record reference region register remove report request resource response
result return root route sample schema script search section select server service session setting size source standard start state status
stream string system table target task template test text thread time title token transaction transform type update upload user utility value
version view window with write zone
allgemein anwendung aufgabe ausgabe bereich beispiel berechnung datei eigenschaft einheit entwicklung ergebnis gesellschaft keit lichkeit nachricht schaft
ung verbindung verwaltung wissenschaft information heit
avec bonjour compte chose dans développement élément entre fichier gestion jour maison mention monde nombre nouveau pour queue temps travail
valeur vers ción archivo ayuda cada como configuracion cuando desarrollo dirección entonces esta fecha gente información llamada mente mundo
nombre nuevo para persona porque todo trabajo valor""".split()
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."


def samples(n: int = 4000, seed: int = 7) -> list[tuple[str, bool]]:
    """n labelled strings, by turns random (True) and ordinary (False), from a seeded rule."""
    rng, out = random.Random(seed), []
    capitals, digits = ALPHABET[:26], ALPHABET[52:62]
    alphabets = [ALPHABET[:64], ALPHABET[:62], ALPHABET[:62] + "-_", capitals + digits, ALPHABET[26:62], digits + capitals[:6], digits + "abcdef"]
    ascii_words = [w for w in WORDS if w.isascii()]
    number = lambda k: str(rng.randrange(10**k))
    for _ in range(n // 2):
        a = rng.choice(alphabets)
        secret = "".join(rng.choices(a, k=rng.randint(20, 64)))
        if "-" in a and rng.random() < 0.3:  # parts of a token, joined by dots
            secret = ".".join([secret, "".join(rng.choices(a, k=rng.randint(20, 64)))])
        out.append((secret, True))
        w, kind = rng.choices(ascii_words, k=rng.randint(2, 6)), rng.randrange(15)
        plain = {
            0: "_".join(w), 1: "_".join(w).upper(), 2: w[0] + "".join(x.title() for x in w[1:]), 3: "".join(x.title() for x in w), 4: "/".join(w),
            5: "".join(w), 6: "".join(w).upper(), 7: f"{'_'.join(w)}_{rng.randrange(10**rng.randint(1, 8))}",
            8: f"{rng.choice(capitals)}{rng.choice(capitals)}{rng.randrange(10**18, 10**22)}" if rng.random() < 0.5 else str(rng.randrange(10**19, 10**26)),
            9: "-".join(w), 10: f"www.{''.join(w[:2])}.{rng.choice(('com', 'org', 'net'))}/{'/'.join(w[2:])}.html", 11: ".".join(w), 12: "-".join(x.title() for x in w) + f".{number(2)}",
            13: f"{rng.randint(1900, 2100)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}-{'-'.join(w)}-v{number(1)}.{number(1)}.{number(2)}", 14: "-".join(number(rng.randint(2, 5)) for _ in range(rng.randint(4, 8))),
        }[kind]
        out.append((plain, False))
    return out


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of character pairs, random against ordinary, and the threshold of their sum."""

    ratio: np.ndarray
    threshold: float

    def score(self, s: str) -> float:
        code = _codes()[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
        return float(self.ratio[np.concatenate([[len(ALPHABET)], code[:-1]]), code].sum())


@lru_cache(1)
def _codes() -> np.ndarray:
    table = np.full(256, len(ALPHABET), np.int64)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    return table


def train(labelled: Iterable[tuple[str, bool]], add: float = 0.5, margin: float = MARGIN) -> MarkovPair:
    """Fit both models on labelled strings: random ones and the first of each two ordinary ones count, the other ordinary ones set the threshold."""
    labelled = list(labelled)
    n = len(ALPHABET) + 1
    counts = np.full((2, n, n), add)
    held = []
    seen = {True: 0, False: 0}
    for s, is_random in labelled:
        seen[is_random] += 1
        if seen[is_random] % 2 or is_random:
            code = _codes()[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            np.add.at(counts[int(is_random)], (np.concatenate([[n - 1], code[:-1]]), code), 1)
        else:
            held.append(s)
    logs = np.log(counts / counts.sum(2, keepdims=True))
    pair = MarkovPair(logs[1] - logs[0], 0.0)
    return MarkovPair(pair.ratio, max(0.0, float(np.quantile([*map(pair.score, held), 0.0], QUANTILE))) + margin)


@lru_cache(1)
def default_model() -> MarkovPair:
    return train(samples())


def find(text: str, model: MarkovPair) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    got = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    got += [("access", *m.span()) for m in ACCESS.finditer(text)]
    got += [("hex", *m.span()) for m in HEX.finditer(text)]
    base, k = sorted((s, e) for _, s, e in got), 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][1] <= at:
            k += 1
        free, j = [], k
        while j < len(base) and base[j][0] < end:  # what patterns' spans leave of the run
            free.append((at, base[j][0]))
            at = max(at, base[j][1])
            j += 1
        for s, e in [*free, (at, end)]:
            if e - s >= MIN_RUN:
                run = text[s:e]
                s, e = e - len(run.lstrip("-.")), s + len(run.rstrip("-."))
                if e - s >= MIN_RUN and model.score(text[s:e]) >= model.threshold:
                    got.append(("markov", s, e))
    return sorted(got, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, column: str = "text", name: str = "spans", model: MarkovPair | None = None) -> DataFrame:
    """docs with the spans of `column`: an array of (kind, start, end), in the order of find()."""
    ready(docs.sparkSession)
    name = fresh(name, docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model or default_model()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in texts(batches, column, 1 << 23):
            got = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in find(t, pair)] if t else [] for t in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, added(docs, [name], [SPANS]))


def joined(spans: str, base_only: bool = False):
    """kind:start:end of the spans, joined by commas."""
    col = F.filter(spans, lambda x: x["kind"] != KINDS[3]) if base_only else F.col(spans)
    return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, column: str = "text", mark: str = "[SECRET]", model: MarkovPair | None = None) -> DataFrame:
    """docs with each maximal stretch of overlapping spans in `column` replaced by `mark`. Texts without spans, null ones too, stay as they are."""
    spans, out = fresh("spans", docs.columns), scan(docs, column, fresh("spans", docs.columns), model)
    # spans come by start: what is kept is the gap from the end so far to the next start
    state = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("text")),
        lambda s, x: F.when(x["start"] < s["at"], F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["text"].alias("text"))).otherwise(
            F.struct(x["end"].alias("at"), F.concat(s["text"], F.substring(F.col(column), s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("text"))
        ),
    )
    done = F.concat(state["text"], F.substring(F.col(column), state["at"] + 1, F.length(column)))
    return out.withColumn(column, F.when(F.size(spans) > 0, done).otherwise(F.col(column))).select(*docs.columns)
