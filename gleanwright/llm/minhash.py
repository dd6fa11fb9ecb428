"""Near duplicates by MinHash: many universal hash minima, banding, signature verification, exact check, connected components.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z lowered; a document's set holds its distinct five-word shingles (all
words as one shingle if there are fewer), as 64-bit hashes. Documents with equal sets are one class, and only one of each class
goes on. PERMUTATIONS minima in BANDS bands make two documents meet with a chance over 0.999994 at similarity 0.75.

Members of a bucket are not paired with one another. First each is checked against one centre, the one that it meets in most
bands; components of these links come next; then only candidates that lie in different components are looked at: the other
centres, all pairs of buckets of at most SMALL members, and larger buckets in blocks, inside which a spanning forest of exact
links is found. Links inside one component cannot change the result, so none that matters is lost and no pair list grows with the
square of a group. Every bucket goes the same way whatever its size: a bucket that stays open costs compares of signatures (in
blocks, bounded in members and bytes) in the number of its members times that of those outside its largest component.
Before its texts are fetched a pair must agree in AGREE minima, five deviations below 0.75; what then passes by hashes is
confirmed on the words themselves.

Defined cases: a document without words, or with a null text, has an empty set and is linked with nothing; very long texts are
taken whole; rows that share a doc_id are one node; a row with a null doc_id takes no part (component null, kept); other columns
are not read, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .common import by_size, cut, forget, fresh, ready, texts
from .components import components

U64 = np.uint64
WORDS, SIMILARITY = 5, 75
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
AGREE = 71
#: Members of a bucket that are paired at once, of a block whose texts are compared, and of one whose signatures are.
SMALL, BLOCK, FINER = 32, 512, 4_096
#: Bytes of texts or signatures of a block, on average; a longer text stays whole.
BLOCK_BYTES = 4 << 20
#: ASCII capitals to small letters.
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


@lru_cache(1)
def _lower() -> np.ndarray:
    return np.frombuffer(LOWER, np.uint8)


@lru_cache(1)
def _space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the universal hash functions x -> (a x + b) / 2**32."""
    rng = np.random.default_rng(99194853094755497 % 2**32)
    return rng.integers(0, 2**63, PERMUTATIONS, dtype=U64) * U64(2) + U64(1), rng.integers(0, 2**63, PERMUTATIONS, dtype=U64)


@lru_cache(1)
def _places() -> np.ndarray:
    return np.random.default_rng(31).integers(0, 2**63, WORDS, dtype=U64) * U64(2) + U64(1)


def shingle_sets(col: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    raw, offsets = bytebpe.column_bytes(col)
    buf = _lower()[np.frombuffer(raw, np.uint8)]
    n = len(buf)
    word = ~_space()[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(word & (edge[:n] | ~np.concatenate([[False], word[:-1]]))) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1 if n else start
    h = bytebpe.span_hashes(buf, start, end)
    at, place = np.searchsorted(start, offsets), _places()
    full = np.zeros(max(len(h) - WORDS + 1, 0), U64)
    for k in range(WORDS):
        full += h[k : k + len(full)] * place[k]
    full = bytebpe.mixed(full)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(full[a : b - WORDS + 1])
        elif b > a:
            yield bytebpe.mixed((h[a:b] * place[: b - a]).sum(keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def signature(s: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set that is not empty."""
    a, b = _hashes()
    low = np.full(PERMUTATIONS, 2**64 - 1, U64)
    for lo in range(0, len(s), 256):
        x = s[lo : lo + 256, None] * a
        x += b
        np.minimum(low, x.min(axis=0), out=low)
    return (low >> U64(32)).astype("<u4")


SKETCH = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_shingles", T.LongType()), ("k1", T.LongType()), ("k2", T.LongType()), ("sig", T.BinaryType()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in texts(batches, "text"):
        n, k1, k2, sig = [], [], [], []
        for s in shingle_sets(b.column("text")):
            n.append(len(s))
            k1.append(int(s.sum().astype(np.int64)))
            k2.append(int(bytebpe.mixed(s ^ U64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
            sig.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], names=SKETCH.names)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are at least SIMILARITY hundredths alike."""
    if 100 * min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= SIMILARITY * (len(x) + len(y) - both)


def word_shingles(text: str) -> set[tuple[bytes, ...]]:
    """The shingles of a text as words. bytes.split() parts at the six ASCII white signs."""
    w = text.encode().translate(LOWER).split()
    return set(zip(*(w[k:] for k in range(WORDS)), strict=False)) if len(w) >= WORDS else {tuple(w)} if w else set()


def linked_words(x: str, y: str) -> bool:
    """linked() for the words of two texts."""
    p, q = word_shingles(x), word_shingles(y)
    both = len(p & q)
    return both > 0 and 100 * both >= SIMILARITY * (len(p) + len(q) - both)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures agree in AGREE minima."""
    for b in batches:
        ok = [int((np.frombuffer(x, "<u4") == np.frombuffer(y, "<u4")).sum()) >= AGREE for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose texts are links."""
    for b in texts(texts(batches, "x"), "y"):
        x, y = b.column("x"), b.column("y")
        ok = [linked(p, q) and linked_words(s.as_py(), t.as_py()) for p, q, s, t in zip(shingle_sets(x), shingle_sets(y), x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _checked(pairs: DataFrame, values: DataFrame, alike) -> DataFrame:
    """The pairs (a, b) whose values, as x and y, pass `alike`."""
    got = pairs.select("a", "b").join(values.select(F.col("doc_id").alias("a"), F.col("val").alias("x")), "a").join(values.select(F.col("doc_id").alias("b"), F.col("val").alias("y")), "b")
    return got.select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def _exact(pairs: DataFrame, sigs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are links: first by signatures, then by the whole texts of the documents that are left."""
    likely = cut(_checked(pairs, sigs, _agree))
    ids = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    some = cut(docs.join(by_size(ids), "doc_id", "left_semi").select("doc_id", F.col("text").alias("val")))
    links = cut(_checked(likely, some, _alike))
    forget(likely, some)
    return links


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """Members of open buckets in blocks of about `block`, beside blocks of those outside the bucket's largest component; pairs inside that need no look.

    Blocks are dealt out by key and both numbers, so the block pairs of one bucket are spread over tasks."""
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("val").cast("long")).alias("bytes"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", "bytes")).alias("m"), F.sum("n").alias("all"), F.sum("bytes").alias("bytes"))
    count = lambda n, size: F.ceil(F.greatest(n / block, size / BLOCK_BYTES)).cast("int")
    probes = count(F.col("all") - F.col("m.n"), F.col("bytes") - F.col("m.bytes"))
    main = main.select("key", F.col("m.comp").alias("main"), count(F.col("all"), F.col("bytes")).alias("nb"), probes.alias("np"))
    dealt = members.join(main, "key").withColumns({"i": F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"), "j": F.pmod(F.xxhash64(F.lit(1), "rep"), F.greatest("np", F.lit(1))).cast("int")})
    both = F.when(F.col("comp") != F.col("main"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = dealt.withColumn("probe", F.explode(both))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("probe") == 1, F.col("nb")).otherwise(F.col("np")) - 1)).alias("o")
    out = dealt.filter("np > 0").select("key", "rep", "comp", "val", "probe", "i", "j", other)
    return out.withColumns({"i": F.when(F.col("probe") == 1, F.col("o")).otherwise(F.col("i")), "j": F.when(F.col("probe") == 1, F.col("j")).otherwise(F.col("o"))}).drop("o").repartition("key", "i", "j")


def _far_pairs(p: pd.DataFrame, near) -> Iterator[tuple[int, int]]:
    """Positions of probes and of members of other components that near() finds."""
    one, two = np.flatnonzero(p["probe"] == 1), np.flatnonzero(p["probe"] == 0)
    comp = p["comp"].to_numpy()
    for x in one.tolist():
        rest = two[comp[two] != comp[x]]
        yield from ((x, y) for y in rest[near(x, rest)].tolist())


def _flag(p: pd.DataFrame) -> pd.DataFrame:
    """Members of a block pair whose signature agrees with one of another component."""
    if p["comp"].nunique() < 2:
        return p.iloc[:0][["key", "rep"]]
    sig, comp = np.stack([np.frombuffer(x, "<u4") for x in p["val"]]), p["comp"].to_numpy()
    one, two, hit = np.flatnonzero(p["probe"] == 1), np.flatnonzero(p["probe"] == 0), np.zeros(len(p), bool)
    for x in one.tolist():
        rest = two[comp[two] != comp[x]]
        near = rest[(sig[rest] == sig[x]).sum(1) >= AGREE]
        hit[near] = True
        hit[x] |= len(near) > 0
    return p[hit][["key", "rep"]]


def _sets(text: list[str]) -> list[np.ndarray]:
    """The shingle sets of texts, made from slices of them: what hashing takes on the way is that of a slice."""
    whole = pa.RecordBatch.from_arrays([pa.array(text, pa.large_string())], names=["text"])
    return [s for b in texts(iter([whole]), "text") for s in shingle_sets(b.column("text"))]


def _forest(p: pd.DataFrame) -> pd.DataFrame:
    """Exact links of a block pair that join different components, a spanning forest of them."""
    text, rep = p["val"].tolist(), p["rep"].to_numpy()
    sets = _sets(text)
    root = {c: c for c in p["comp"]}

    def top(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    comp, out = p["comp"].to_numpy(), []
    near = lambda x, rest: np.array([top(comp[x]) != top(comp[y]) and linked(sets[x], sets[y]) and linked_words(text[x], text[y]) for y in rest], bool)
    for x, y in _far_pairs(p, near) if len(root) > 1 else ():
        if (s := top(comp[x])) != (t := top(comp[y])):
            root[s] = t
            out.append((rep[x], rep[y]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = cut(docs.mapInArrow(_sketch, SKETCH))
    key = ["k1", "k2", "n_shingles"]
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    reps = cut(some.join(classes, key).filter("doc_id = rep").select("rep", "sig"))
    sigs = reps.select(F.col("rep").alias("doc_id"), F.col("sig").alias("val"))
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("key")
    bands = reps.select("rep", band)
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high")).filter("size > 1")
    met = cut(bands.join(buckets, "key"))

    # each member and the centre that it meets most often
    stars = cut(met.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("rep").alias("b")), F.struct(F.col("rep").alias("a"), F.col("high").alias("b")))).alias("p")).select("p.*").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    links = _exact(best, sigs, docs)
    comp = cut(components(links))

    def apart(pairs: DataFrame, now: DataFrame) -> DataFrame:
        """The pairs whose ends lie in different components."""
        ca, cb = (now.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        return pairs.select("a", "b").join(ca, "a", "left").join(cb, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def open_members(most: str, now: DataFrame) -> DataFrame:
        """Members of buckets that still hold more than one component."""
        own = met.filter(most).join(now.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
        many = own.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key")
        return own.join(many, "key", "left_semi")

    small = open_members(f"size <= {SMALL}", comp)
    other = small.select("key", F.col("rep").alias("r2"), F.col("comp").alias("c2"))
    small = small.join(other, "key").filter("rep < r2 AND comp <> c2").select(F.col("rep").alias("a"), F.col("r2").alias("b"))
    rest = cut(apart(stars, comp).unionByName(small).distinct().join(best, ["a", "b"], "left_anti"))
    more = _exact(rest, sigs, docs)
    links = links.unionByName(more)
    comp = cut(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    large = open_members(f"size > {SMALL}", comp)
    large = cut(large.select("key", "rep", "comp"))
    if not large.isEmpty():
        flagged = cut(_blocks(large.join(sigs.withColumnRenamed("doc_id", "rep"), "rep"), FINER).groupBy("key", "i", "j").applyInPandas(lambda p: _flag(p), "key long, rep long").distinct())
        whole = cut(docs.join(by_size(flagged.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("text").alias("val")))
        found = cut(_blocks(large.join(flagged, ["key", "rep"], "left_semi").join(whole, "rep"), BLOCK).groupBy("key", "i", "j").applyInPandas(lambda p: _forest(p), "a long, b long"))
        comp = cut(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)))
        forget(flagged, whole, found)
    forget(met, stars, rest, large, reps)

    label = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    full = some.join(label, key).select("doc_id", "n_shingles", "component_id")
    empty = sketch.filter("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the documents of each group of near duplicates but the one with the smallest doc_id. Columns stay.

    A row with a null doc_id takes part under a made-up id after all others, and of rows that repeat a doc_id and its text one
    stays. Texts without words all stay."""
    own = fresh("own", docs.columns)
    made = F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    rows = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), made))
    gone = near_duplicates(rows.select(F.col(own).alias("doc_id"), "text")).filter("NOT kept").select(F.col("doc_id").alias(own)).distinct()
    left = rows.join(by_size(gone), own, "left_anti")
    twice = rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).groupBy(own, F.xxhash64("text")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own).distinct()
    twice = cut(twice)
    if not twice.isEmpty():
        left = left.join(by_size(twice), own, "left_anti").unionByName(left.join(by_size(twice), own, "left_semi").dropDuplicates([own, "text"]))
    return left.select(*docs.columns)
