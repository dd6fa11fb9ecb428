"""Token counts by dynamic programming over prefixes.

For a byte-level BPE, the encoding of a prefix ends in exactly one token t whose predecessor, the last token of the shorter
prefix, stands beside t without a merge across their border. So one pass from left to right, with the last token of each prefix
kept, gives the exact count at every prefix. Whether two tokens may stand side by side is decided by undoing their merges from
the latest on. Which tokens begin where is read off a tree of all tokens, for all places at once. Pieces of the pre-tokeniser are
independent, so each distinct piece is solved once, thousands together; a long one (text without spaces) is solved in stretches.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); very long texts are counted whole, and so are very long pieces;
repeated rows are counted one by one; an empty table stays empty; other columns pass, and new ones whose names are taken get an
underscore in front.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytebpe
from .bpe_codec import added
from .common import fresh, ready, texts

#: Longer pieces are solved one by one, in stretches of so many bytes.
LONG, STRETCH = 48, 1 << 16


class Prefixes:
    """Counts at every prefix of pieces, for a byte-level BPE in a .json file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        back = {c: i for i, c in enumerate(bytebpe.byte_chars())}
        as_bytes = {t: bytes(back[c] for c in t) for t in model["vocab"] if all(c in back for c in t)}
        self.ids = {as_bytes[t]: i for t, i in model["vocab"].items() if t in as_bytes}
        n = max(self.ids.values()) + 1
        self.left, self.right = np.arange(n), np.arange(n)
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = (self.ids[as_bytes[t]] for t in (merge if isinstance(merge, list) else merge.split(" ")))
            own = self.ids[as_bytes[merge[0] + merge[1]] if isinstance(merge, list) else as_bytes[merge.replace(" ", "")]]
            self.left[own], self.right[own] = a, b
            self.pairs[a, b] = own
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.array([*self.pairs.values()], np.int64)[order]
        self.one_pairs = {a << 32 | b: own for (a, b), own in self.pairs.items()}
        self.lefts, self.rights = self.left.tolist(), self.right.tolist()
        self.longest = max(map(len, self.ids))
        self.known: dict[int, bool] = {}
        self._tree()

    def _tree(self) -> None:
        """All tokens as a tree of bytes: sorted (node, byte) keys with the node that each leads to, and each node's token or -1."""
        nodes, token = {b"": 0}, [-1]
        edges: dict[int, int] = {}
        for t in sorted(self.ids, key=len):
            at = 0
            for k in range(1, len(t) + 1):
                then = nodes.get(t[:k])
                if then is None:
                    then = nodes[t[:k]] = len(token)
                    token.append(-1)
                    edges[at << 8 | t[k - 1]] = then
                at = then
            token[at] = self.ids[t]
        keys = np.array([*edges], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array([*edges.values()], np.int64)[order]
        self.node_token = np.array(token, np.int64)

    def matches(self, buf: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every token that stands in buf: first byte, end, id. stop: for each byte, the end of its piece."""
        at, node = np.arange(len(buf)), np.zeros(len(buf), np.int64)
        out = []
        for size in range(self.longest):
            key = node << 8 | buf[at + size]
            where = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            alive = np.flatnonzero(self.edge_keys[where] == key)
            at, node = at[alive], self.edge_to[where[alive]]
            token = self.node_token[node]
            some = np.flatnonzero(token >= 0)
            out.append((at[some], at[some] + size + 1, token[some]))
            on = at + size + 1 < stop[at]
            at, node = at[on], node[on]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when the text of both is encoded together."""
        ok, todo, a, b = np.zeros(len(a), bool), np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40)
        while len(todo):
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit)
            todo, a, b = todo[~clash], a[~clash], b[~clash]
            # undo the later merge of the two; if that one is a single byte, the other; if both are, they may stand
            left_first = a > b
            a_next, b_next = self.right[a], self.left[b]
            undo_a = np.where(left_first, a_next != a, (b_next == b) & (a_next != a))
            undo_b = np.where(left_first, (a_next == a) & (b_next != b), b_next != b)
            limit = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, a_next, a), np.where(undo_b, b_next, b)
            done = ~undo_a & ~undo_b
            ok[todo[done]] = True
            todo, a, b, limit = todo[~done], a[~done], b[~done], limit[~done]
        return ok

    def _beside(self, a: int, b: int) -> bool:
        """beside() for one pair."""
        limit = 1 << 62
        while True:
            if self.one_pairs.get(a << 32 | b, limit) < limit:
                return False
            a_next, b_next = self.rights[a], self.lefts[b]
            if a_next != a and (a > b or b_next == b):
                limit, a = a, a_next
            elif b_next != b:
                limit, b = b + 1, b_next
            else:
                return True

    def one(self, word: bytes) -> np.ndarray:
        """The count at each prefix of a piece of any length."""
        buf, n, known = np.frombuffer(word, np.uint8), len(word), self.known
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for lo in range(0, n, STRETCH):
            hi, back = min(n, lo + STRETCH), max(0, lo - self.longest)
            part = buf[back:hi]
            i, j, t = self.matches(part, np.full(len(part), len(part)))
            i, j = i + back, j + back
            mine = np.flatnonzero(j > lo)
            i, j, t = i[mine], j[mine], t[mine]
            order = np.lexsort((i, j))  # by end, longest first
            i, t, first = i[order].tolist(), t[order].tolist(), np.searchsorted(j[order], np.arange(lo + 1, hi + 2)).tolist()
            for j in range(lo + 1, hi + 1):
                for k in range(first[j - lo - 1], first[j - lo]):
                    s = i[k]
                    if s:
                        key = last[s] << 32 | t[k]
                        fits = known.get(key)
                        if fits is None:
                            if len(known) > 1_000_000:
                                known.clear()
                            fits = known[key] = self._beside(last[s], t[k])
                        if not fits:
                            continue
                    last[j], count[j] = t[k], count[s] + 1
                    break
        return np.array(count[1:], np.int32)

    def many(self, words: list[bytes]) -> list[np.ndarray]:
        """The count at each prefix of pieces of at most LONG bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        begin = ends - size
        row_of = np.repeat(np.arange(len(words)), size)
        at, end, token = self.matches(np.frombuffer(b"".join(words), np.uint8), ends[row_of])
        rows = row_of[at]
        i, j = at - begin[rows], end - begin[rows]
        order = np.lexsort((i, rows, j))  # by end, then piece, longest first
        rows, i, j, token = rows[order], i[order], j[order], token[order]
        fresh_group = np.ones(len(rows), bool)
        fresh_group[1:] = (rows[1:] != rows[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(fresh_group)
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        order = np.lexsort((rank, j))
        rows, i, j, token, rank = rows[order], i[order], j[order], token[order], rank[order]
        borders = np.flatnonzero(np.concatenate([[True], (j[1:] != j[:-1]) | (rank[1:] != rank[:-1])])).tolist()
        last, count = np.full((len(words), LONG + 1), -1, np.int64), np.zeros((len(words), LONG + 1), np.int32)
        for lo, hi in zip(borders, [*borders[1:], len(rows)], strict=True):
            r, s, t, e = rows[lo:hi], i[lo:hi], token[lo:hi], int(j[lo])
            if rank[lo]:
                todo = np.flatnonzero(last[r, e] < 0)
                r, s, t = r[todo], s[todo], t[todo]
            inner = np.flatnonzero(s > 0)
            fits = np.ones(len(r), bool)
            fits[inner] = self.beside(last[r[inner], s[inner]], t[inner])
            r, s, t = r[fits], s[fits], t[fits]
            last[r, e], count[r, e] = t, count[r, s] + 1
        return [count[k, 1 : n + 1] for k, n in enumerate(size.tolist())]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """All counts, one piece after another, and the size of each piece."""
        out: list = [None] * len(words)
        for i, w in enumerate(words):
            if w == bytebpe.SPECIAL:
                out[i] = [1] * len(w)
            elif len(w) > LONG:
                out[i] = self.one(w)
        order = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(order), 20_000):
            some = order[lo : lo + 20_000]
            for i, x in zip(some, self.many([words[i] for i in some]), strict=True):
                out[i] = x
        return np.concatenate(out), list(map(len, words))


class PrefixEncoder(bytebpe.Encoder):
    """Keeps, for each distinct piece, the counts at all its prefixes."""

    def __init__(self, path: str):
        super().__init__(Prefixes(path), True)

    def counts(self, col: pa.Array) -> np.ndarray:
        raw, offsets = bytebpe.column_bytes(col)
        buf, start, end, before = bytebpe.split(raw, offsets, True)
        entry = self.cache.entries(raw, buf, start, end)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.cache.flat[self.cache.off[entry] + self.cache.size[entry] - 1], out=total[1:])
        return np.diff(total[before])

    def totals(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        """For each byte, the exact token count of its text up to and with it, where a character ends; of texts without special strings."""
        buf, start, end, before = bytebpe.split(raw, offsets, False)
        entry = self.cache.entries(raw, buf, start, end)
        size, off = end - start, self.cache.off[entry]
        run = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.cache.flat[off + size - 1], out=run[1:])
        base = run[:-1] - run[before[np.searchsorted(before, np.arange(len(start)), "right") - 1]]
        _, place, _ = bytebpe.spread_spans(start, end)
        out = np.repeat(base, size) + self.cache.flat[np.repeat(off, size) + place]
        # 're, 've and 'll are no pieces yet after their first letter
        three = np.flatnonzero((size == 3) & (buf[start] == 39))
        b, c = buf[start[three] + 1], buf[start[three] + 2]
        three = three[(((b == 114) | (b == 118)) & (c == 101)) | ((b == 108) & (c == 108))]
        out[start[three] + 1] = base[three] + 2
        # a prefix that ends with a run of white space keeps that run whole
        n = len(buf)
        white = bytebpe.byte_classes(buf) == bytebpe.SPACE
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first = np.flatnonzero(white & (edge[:n] | ~np.concatenate([[False], white[:-1]])))
        last = np.flatnonzero(white & (edge[1:] | ~np.concatenate([white[1:], [False]])))
        inner = (last > first) & ~edge[last + 1]
        first, last = first[inner], last[inner]
        if len(first):
            e = self.cache.entries(raw, buf, first, last + 1)
            out[last] = np.where(edge[first], 0, out[first - 1]) + self.cache.flat[self.cache.off[e] + self.cache.size[e] - 1]
        return out

    def _marked(self, raw: bytes) -> np.ndarray:
        """totals() of one text that may hold special strings: they are tokens of their own once they are whole."""
        out, base, prior = [], 0, b""
        for k, part in enumerate(raw.split(bytebpe.SPECIAL)):
            if k:
                for n in range(1, len(bytebpe.SPECIAL)):
                    begun = prior + bytebpe.SPECIAL[:n]
                    out.append(base + self.totals(begun, np.array([0, len(begun)]))[-1:])
                base += int(self.totals(prior, np.array([0, len(prior)]))[-1]) if prior else 0
                base += 1
                out.append(np.array([base]))
            if part:
                out.append(base + self.totals(part, np.array([0, len(part)])))
            prior = part
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def prefixes(self, text: str) -> list[int]:
        """The exact token count of text[:i], for each i from 0 on."""
        raw = text.encode()
        if not raw:
            return [0]
        total = self._marked(raw)
        return [0, *total[_ends(np.frombuffer(raw, np.uint8))].tolist()]

    def fitting(self, col: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of tokens, and of code points in its longest prefix of at most `limit` tokens."""
        n, fits = self.counts(col), pa.compute.fill_null(pa.compute.utf8_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in np.flatnonzero(n > limit).tolist():
            raw = col[i].as_py().encode()
            total = self._marked(raw)
            fits[i] = np.flatnonzero(np.append(0, total[_ends(np.frombuffer(raw, np.uint8))]) <= limit)[-1]
        return n, fits


def _ends(buf: np.ndarray) -> np.ndarray:
    """The last byte of each character."""
    return np.flatnonzero(np.append((buf[1:] & 0xC0) != 0x80, True))


@lru_cache(4)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


@lru_cache(4)
def _pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(4)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def byte_level(path: str) -> bool:
    """Whether the file is a byte-level BPE of the tokenizers library, without normaliser, as the prefix solver needs it."""
    if path.endswith(".model"):
        return False
    with open(path) as f:
        j = json.load(f)
    return j["model"]["type"] == "BPE" and (j["pre_tokenizer"] or {}).get("type") == "ByteLevel" and j["normalizer"] is None


def count_tokens(docs: DataFrame, path: str, column: str = "text", limit: int = 1024, names: tuple[str, ...] = ("n_bytes", "n_tokens", "over_limit"), fits: str | None = None) -> DataFrame:
    """docs with the bytes and tokens of each whole text, and whether they are more than `limit`. Byte-level files are solved by
    prefixes; for others (.model: sentencepiece; .json: tokenizers) the library itself counts. fits names a further column, for
    byte-level files: the code points of the longest prefix of at most `limit` tokens, from the counts at prefixes."""
    ready(docs.sparkSession)
    n_bytes, n_tokens, over = (fresh(n, docs.columns) for n in names)
    fit = [fresh(fits, docs.columns)] if fits else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts(batches, column):
            col = b.column(column)
            if fit:
                new = prefix_encoder(path).fitting(col, limit)
            elif byte_level(path):
                new = [prefix_encoder(path).counts(col)]
            else:
                whole = [x or "" for x in col.to_pylist()]
                new = [[len(x) for x in _pieces_model(path).encode(whole, num_threads=1)] if path.endswith(".model") else [len(e.ids) for e in _library(path).encode_batch(whole, add_special_tokens=False)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in new)], names=[*b.schema.names, n_tokens, *fit])

    out = docs.mapInArrow(run, added(docs, [n_tokens, *fit], [T.LongType()] * (1 + len(fit))))
    return out.withColumns({n_bytes: F.coalesce(F.octet_length(column), F.lit(0)).cast("long"), over: F.col(n_tokens) > limit}).select(*docs.columns, n_bytes, n_tokens, over, *fit)


def prefix_counts(docs: DataFrame, path: str, column: str = "text", name: str = "prefix_tokens") -> DataFrame:
    """docs with the token count of every prefix of `column`, by code points: element i+1 is the count of the first i."""
    ready(docs.sparkSession)
    name = fresh(name, docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = prefix_encoder(path)
        for b in texts(batches, column):
            got = [solver.prefixes(x or "") for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.int64()))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, added(docs, [name], [T.ArrayType(T.LongType())]))


def truncate(df: DataFrame, budget: int, column: str = "text", counts: str = "prefix_tokens", name: str = "truncated") -> DataFrame:
    """df with the longest prefix of `column` of at most `budget` tokens, from stored counts and without encoding again."""
    fits = F.array_max(F.filter(F.transform(F.col(counts), lambda n, i: F.when(n <= budget, i)), lambda i: i.isNotNull()))
    return df.withColumn(fresh(name, df.columns), F.col(column).substr(F.lit(1), fits.cast("int")))
