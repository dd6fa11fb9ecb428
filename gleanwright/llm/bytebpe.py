"""Byte-level BPE over whole columns: numpy splits UTF-8 bytes where the public pattern does, and each distinct piece is encoded once.

The pattern is P.PATTERN of public_tokenizers: contractions, then runs of letters, of digits and of other signs, each with one
space before it, then white space. A piece never depends on text outside it but for white space, whose last character goes to
what follows; so pieces can be found by comparing neighbouring characters, all at once. Pieces are found in the cache by a 64-bit
hash of their bytes and are compared with the cached bytes on every hit, so two pieces with one hash still get their own ids.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
SPECIAL = b"<|endoftext|>"
#: Code points with the White_Space property.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
U64 = np.uint64
SLOT_BITS, MOST_PIECES, MOST_BYTES = 20, 1_500_000, 1 << 26
#: Places within a span whose values are kept in a table.
PLACES = 64


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[list(WHITE)] = SPACE
    return table


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def drawn(place: np.ndarray, sign: np.ndarray, bits: int = 8) -> np.ndarray:
    """A pseudo-random number for each sign (of `bits` bits) at each place. Sums of them have no structure that repeated text could meet."""
    return mixed((place.astype(U64) << U64(bits) | sign.astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(0x9E3779B97F4A7C15))


@lru_cache(1)
def _drawn_bytes() -> np.ndarray:
    return drawn(np.repeat(np.arange(PLACES), 256), np.tile(np.arange(256), PLACES))


def spread_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions of all spans, one span after another; each position's place in its span; and where each span ends among them."""
    size = end - start
    total = np.cumsum(size)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size)
    return place + np.repeat(start, size), place, total


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: the sum of a number for each byte at its place in the span, mixed."""
    at, place, total = spread_spans(start, end)
    sign = buf[at]
    value = _drawn_bytes()[np.minimum(place, PLACES - 1) << 8 | sign]
    if len(far := np.flatnonzero(place >= PLACES)):
        value[far] = drawn(place[far], sign[far])
    run = np.zeros(len(value) + 1, U64)
    np.cumsum(value, out=run[1:])
    return mixed(run[total] - run[total - (end - start)] + (end - start).astype(U64))


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the class of its character."""
    n = len(buf)
    cls = classes()[buf]
    if len(lead := np.flatnonzero(buf >= 0xC0)):
        pad = np.concatenate([buf, np.zeros(4, np.uint8)])
        b0, b1, b2, b3 = (pad[lead + k].astype(np.uint32) for k in range(4))
        t1, t2, t3 = b1 & 63, b2 & 63, b3 & 63
        cp = np.where(b0 < 0xE0, (b0 & 31) << 6 | t1, np.where(b0 < 0xF0, (b0 & 15) << 12 | t1 << 6 | t2, (b0 & 7) << 18 | t1 << 12 | t2 << 6 | t3))
        kind = classes()[np.minimum(cp, 0x10FFFF)]
        cls[lead] = kind
        for k, least in ((1, 0), (2, 0xE0), (3, 0xF0)):
            at = lead + k
            ok = (b0 >= least) & (at < n)
            cls[at[ok]] = kind[ok]
    return cls


def pieces(buf: np.ndarray, first: np.ndarray, special: np.ndarray | None = None) -> np.ndarray:
    """Where pieces start in buf (UTF-8). first: where each text starts, ascending, without empty texts; special: which texts are one piece."""
    n = len(buf)
    cls = byte_classes(buf)
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    change = begins[:n].copy()
    change[1:] |= cls[1:] != cls[:-1]
    start = np.zeros(n + 2, bool)
    white = cls == SPACE
    start[:n] = change & white
    word = np.flatnonzero(change & ~white)
    after = word[(word > 0) & ~begins[word] & (cls[word - 1] == SPACE)]
    start[word] = True
    # the last white character before a word is a piece of its own, or, if a plain space, the head of the word's piece
    back = np.ones(len(after), np.int64)
    for k in (1, 2):
        back += (back == k) & ((buf[after - k] & 0xC0) == 0x80)
    start[after - back] = True
    start[after[buf[after - 1] == 32]] = False
    quote = np.flatnonzero(buf == 39)
    quote = quote[start[quote] & (quote + 1 < n)]
    quote = quote[(cls[quote + 1] == LETTER) & ~begins[quote + 1]]
    if len(quote):
        a, b = buf[quote + 1], buf[np.minimum(quote + 2, n - 1)]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        three = (quote + 2 < n) & ~begins[np.minimum(quote + 2, n)] & ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108)))
        for at, size in ((quote[two], 2), (quote[three], 3)):
            start[at + 1] = False
            start[at + size] = True
    if special is not None and special.any():
        ends = np.append(first[1:], n)
        for s, e in zip(first[special].tolist(), ends[special].tolist(), strict=True):
            start[s + 1 : e] = False
    start[first] = True
    return np.flatnonzero(start[:n])


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, made longer until it holds n."""
    while len(x) < n:
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class Cache:
    """What `encode` gives for each distinct piece, kept for the life of the worker process."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], list[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, U64), np.zeros(0, np.int32)  # hashes in order, and their entries
        self.slot_hash = np.zeros(1 << SLOT_BITS, U64)
        self.slot_entry = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0
        self.off, self.size, self.n = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32), 0
        self.text, self.text_used = np.zeros(1 << 20, np.uint8), 0  # the pieces themselves
        self.text_off, self.text_size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _add(self, words: list[bytes]) -> np.ndarray:
        flat, sizes = map(np.array, self.encode(words))
        text, lengths = b"".join(words), np.fromiter(map(len, words), np.int64, len(words))
        more, k = len(flat), len(sizes)
        self.flat, self.text = _room(self.flat, self.used + more), _room(self.text, self.text_used + len(text))
        self.off, self.size, self.text_off, self.text_size = (_room(x, self.n + k) for x in (self.off, self.size, self.text_off, self.text_size))
        self.text[self.text_used : self.text_used + len(text)] = np.frombuffer(text, np.uint8)
        self.text_off[self.n : self.n + k] = self.text_used + np.cumsum(lengths) - lengths
        self.text_size[self.n : self.n + k] = lengths
        self.text_used += len(text)
        if more:
            self.flat[self.used : self.used + more] = flat
        self.off[self.n : self.n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + k] = sizes
        self.used, self.n = self.used + more, self.n + k
        return np.arange(self.n - k, self.n, dtype=np.int32)

    def entries(self, raw: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each piece."""
        if self.n > MOST_PIECES or self.text_used > MOST_BYTES:
            self.clear()
        h = span_hashes(buf, start, end)
        slot = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        entry = self.slot_entry[slot]
        if len(miss := np.flatnonzero((self.slot_hash[slot] != h) | (h == 0))):
            uniq, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            where = np.searchsorted(self.keys, uniq)
            known = np.full(len(uniq), -1, np.int32)
            if len(self.keys):
                near = np.minimum(where, len(self.keys) - 1)
                known = np.where(self.keys[near] == uniq, self.at[near], known)
            if len(new := np.flatnonzero(known < 0)):
                p = miss[at[new]]
                known[new] = self._add([raw[s:e] for s, e in zip(start[p].tolist(), end[p].tolist(), strict=True)])
                self.keys, self.at = np.insert(self.keys, where[new], uniq[new]), np.insert(self.at, where[new], known[new])
            entry[miss] = known[back]
            where = (uniq >> U64(64 - SLOT_BITS)).astype(np.int64)
            self.slot_hash[where], self.slot_entry[where] = uniq, known
        if len(other := self._unlike(entry, buf, start, end)):
            entry[other] = self._add([raw[s:e] for s, e in zip(start[other].tolist(), end[other].tolist(), strict=True)])
        return entry

    def _unlike(self, entry: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pieces that are not, byte for byte, those of their entries."""
        off = self.text_off[entry]
        bad = self.text_size[entry] != end - start
        at, place, total = spread_spans(start, end)
        own = np.minimum(place + np.repeat(off, end - start), len(self.text) - 1)
        if len(wrong := np.flatnonzero(self.text[own] != buf[at])):
            bad[np.searchsorted(total, wrong, "right")] = True
        return np.flatnonzero(bad)

    def ids(self, entry: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after another."""
        sizes = self.size[entry].astype(np.int64)
        total = np.cumsum(sizes)
        if not len(total):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.off[entry] - (total - sizes), sizes) + np.arange(total[-1])]


def column_bytes(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a string column and where its texts begin and end; a null is an empty text."""
    col = pa.compute.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    return raw, offsets - offsets[0]


def split(raw: bytes, offsets: np.ndarray, specials: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """buf, starts and ends of the pieces, and for each text the number of pieces before it (one more entry than texts)."""
    buf = np.frombuffer(raw, np.uint8)
    first, special = offsets[:-1][offsets[1:] > offsets[:-1]], None
    if specials and SPECIAL in raw:
        at, cuts = raw.find(SPECIAL), []
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right"))
            if at + len(SPECIAL) <= offsets[k]:  # not across two texts
                cuts.append(at)
                at = raw.find(SPECIAL, at + len(SPECIAL))
            else:
                at = raw.find(SPECIAL, at + 1)
        cuts = np.array(cuts, np.int64)
        first = np.unique(np.concatenate([first, cuts, cuts + len(SPECIAL)]))
        first = first[first < len(raw)]
        special = np.isin(first, cuts)
    if not len(buf):
        none = np.zeros(0, np.int64)
        return buf, none, none, np.zeros(len(offsets), np.int64)
    start = pieces(buf, first, special)
    return buf, start, np.append(start[1:], len(buf)), np.searchsorted(start, offsets)


class Encoder:
    """Encodes columns with a cache of pieces. specials: whether the special string inside a text is its own id."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], list[int]]], specials: bool):
        self.cache, self.specials = Cache(encode), specials

    def counts(self, col: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        raw, offsets = column_bytes(col)
        buf, start, end, before = split(raw, offsets, self.specials)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.cache.size[self.cache.entries(raw, buf, start, end)], out=total[1:])
        return np.diff(total[before])

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more entry than texts)."""
        raw, offsets = column_bytes(col)
        buf, start, end, before = split(raw, offsets, self.specials)
        entry = self.cache.entries(raw, buf, start, end)
        total = np.zeros(len(start) + 1, np.int64)
        np.cumsum(self.cache.size[entry], out=total[1:])
        return self.cache.ids(entry), total[before]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def parts(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes `token`: what is left when only lower ranks may merge."""
    own, seq = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(seq) > 2:
        low, at = min((ranks.get(seq[i] + seq[i + 1], own), i) for i in range(len(seq) - 1))
        if low >= own:
            break
        seq[at : at + 2] = [seq[at] + seq[at + 1]]
    return (seq[0], b"".join(seq[1:])) if len(seq) == 2 else (b"", b"")


def by_pieces(t, special: int | None = None) -> Callable[[list[bytes]], tuple[list[int], list[int]]]:
    """Encodes given pieces by the model of a tokenizers Tokenizer, in the characters that stand for their bytes. special: the id of SPECIAL, if it has one."""
    model, chars = t.model, dict(enumerate(byte_chars()))

    def encode(words: list[bytes]) -> tuple[list[int], list[int]]:
        flat: list[int] = []
        sizes = []
        for w in words:
            ids = [special] if special is not None and w == SPECIAL else [x.id for x in model.tokenize(w.decode("latin-1").translate(chars))]
            sizes.append(len(ids))
            flat += ids
        return flat, sizes

    return encode


@lru_cache(4)
def library_encoder(path: str, specials: bool = True) -> Encoder:
    """Pieces are encoded by the tokenizers library from its .json file."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return Encoder(by_pieces(t, t.token_to_id(SPECIAL.decode()) if specials else None), specials)


@lru_cache(4)
def ranks_encoder(path: str) -> Encoder:
    """Pieces are encoded by the tokenizers library with a model made from a rank file; no special tokens."""
    from tokenizers import Tokenizer, models

    ranks, chars = read_ranks(path), byte_chars()
    shown = {b: "".join(chars[x] for x in b) for b in ranks}
    merges = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.get):
        a, b = parts(token, ranks)
        if a:
            merges.append((shown[a], shown[b]))
    t = Tokenizer(models.BPE(vocab={shown[b]: r for b, r in ranks.items()}, merges=merges))
    return Encoder(by_pieces(t), False)
