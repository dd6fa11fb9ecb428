"""A linear-chain conditional random field over word shapes: training and Viterbi decoding in numpy, over whole batches of texts.

A token is a run of letters, a run of digits or one other sign. What the field sees of a token, and of the two before and after it,
is its shape (kind, capitals, length, sign, whether white space or the same word stands before it) and, for words that the labelled table has
often enough, which word it is (its first eight bytes in lower case, and its length). A sequence ends at a line's end, and where a full stop after a word of
over three letters, or another closing sign, is followed by a capital. Labels are O, and first and further token of each kind.

Most tokens are O. A run of other labels gains no more over O than the sum of its tokens' best gains and of the dearest steps; a
token that lies in no run whose bound is positive is O in a best labelling, and the islands between such tokens are independent
of one another. Only islands are decoded by Viterbi, side by side, longest first; the labelling is that of whole sequences.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from .bytebpe import mixed

WHITE, LETTER, DIGIT, SIGN = range(4)
REACH, BATCH, NEVER = 2, 2048, -50.0
U64 = np.uint64
LENGTHS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 6, 7, 9, 12], np.arange(64)), 9)
DIGITS = np.minimum(np.searchsorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 19], np.arange(64)), 11)
SHAPES = 4 * (50 + 12 + 128) + 1


def _table() -> np.ndarray:
    out = np.full(256, SIGN, np.uint8)
    out[:33] = out[127] = WHITE
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    out[48:58] = DIGIT
    return out


CLASSES = _table()


@dataclass(frozen=True)
class Tokens:
    """Tokens of all texts: where they lie in the bytes, what they look like, and where sequences begin."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    begins: np.ndarray


def tokens(buf: np.ndarray, first: np.ndarray) -> Tokens:
    """Tokens of buf (UTF-8); first: where each text starts."""
    n = len(buf)
    kind = CLASSES[buf]
    upper = (buf >= 65) & (buf <= 90)
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    if len(lead := np.flatnonzero(buf >= 0xC0)):
        a, b = buf[lead], pad[lead + 1]
        upper[lead[(a == 0xC3) & (b < 0x9F) & (b != 0x97)]] = True
        # signs and spaces of U+0080-00BF and U+2000-207F part words
        for gap, size in ((lead[a == 0xC2], 2), (lead[(a == 0xE2) & ((b == 0x80) | (b == 0x81))], 3)):
            for k in range(size):
                kind[gap[gap + k < n] + k] = WHITE
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == SIGN)
    change[first[first < n]] = True
    edges = np.append(np.flatnonzero(change), n)
    start, end = edges[:-1], edges[1:]
    solid = kind[start] != WHITE
    start, end = start[solid], end[solid]
    k, sign = kind[start], buf[start]
    letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    size = letters[end] - letters[start]
    caps = np.concatenate([[0], np.cumsum(upper)])
    caps = caps[end] - caps[start]
    head = upper[start]
    form = np.where(caps == 0, 0, np.where(size == 1, 3, np.where(caps == size, 2, np.where(head & (caps == 1), 1, 4))))
    at = np.minimum(size, 63)
    shape = np.where(k == LETTER, form * 10 + LENGTHS[at], np.where(k == DIGIT, 50 + DIGITS[at], 62 + (sign & 127)))
    spaced = np.ones(len(start), bool)
    spaced[1:] = start[1:] != end[:-1]
    # the word: first eight bytes, small
    eight = np.lib.stride_tricks.sliding_window_view(pad, 8)[start] if len(start) else np.zeros((0, 8), np.uint8)
    eight = np.where((eight >= 65) & (eight <= 90), eight | 32, eight)
    eight = np.where(np.arange(8) < (end - start)[:, None], eight, 0).astype(np.uint8)
    word = mixed(np.ascontiguousarray(eight).view("<u8").ravel() + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))
    word[k == SIGN] = 0
    again = np.zeros(len(start), bool)
    for back in (1, 2):
        again[back:] |= (word[back:] == word[:-back]) & (word[back:] != 0)
    shape = (shape * 2 + spaced) * 2 + again + 1
    # sequences
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    begins = np.zeros(len(start), bool)
    if len(start):
        begins[0] = True
        begins[1:] = lines[start[1:]] != lines[start[:-1]]
        stop = (sign == 33) | (sign == 63)
        stop[1:] |= (sign[1:] == 46) & (size[:-1] > 3)
        begins[1:] |= stop[:-1] & spaced[1:] & head[1:]
        texts = np.searchsorted(start, first[first < n])
        begins[texts[texts < len(start)]] = True
    return Tokens(start, end, shape.astype(np.int32), word, np.flatnonzero(begins))


@dataclass(frozen=True)
class Field:
    """Weights: of shapes and words at each distance, and of label pairs; words: the known ones, ascending."""

    labels: tuple[str, ...]
    words: np.ndarray
    shape: np.ndarray
    word: np.ndarray
    pair: np.ndarray

    def known(self, word: np.ndarray) -> np.ndarray:
        """The number of each word from 1, or 0."""
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[at] == word, at + 1, 0)

    def decode(self, t: Tokens, caution: float = 0.0) -> np.ndarray:
        """The best label of each token; caution: what O is worth beside its weights."""
        out = np.zeros(len(t.start), np.uint8)
        if not len(out):
            return out
        begins = np.zeros(len(out), np.int64)
        begins[t.begins] = 1
        number = np.cumsum(begins)
        place = np.arange(len(out)) + REACH * number
        spaced = np.zeros(place[-1] + 1 + REACH, np.int32)
        spaced[place] = t.shape
        words = np.zeros(len(spaced), np.int32)
        words[place] = self.known(t.word)
        e = np.zeros((len(spaced), len(self.labels)), np.float32)
        some = np.flatnonzero(words)
        for o in range(-REACH, REACH + 1):
            lo, hi = max(0, -o), len(spaced) - max(0, o)
            e[lo:hi] += self.shape[o + REACH][spaced[lo + o : hi + o]]
            there = some[(some - o >= 0) & (some - o < len(spaced))]
            e[there - o] += self.word[o + REACH][words[there]]
        e = e[place]
        e[:, 0] += caution
        # what a run of other labels can gain over O at most: its tokens' gains and steps, and its two ends
        a = self.pair
        step = float(a[1:, 1:].max() - a[0, 0])
        edge = max(0.0, float(max(a[0, 1:].max(), 0.0) + max(a[1:, 0].max(), 0.0) - 2 * min(a[0, 0], 0.0)) - step)
        gain = e[:, 1].copy()
        for j in range(2, len(self.labels)):
            np.maximum(gain, e[:, j], out=gain)
        total = np.concatenate([[0.0], np.cumsum((gain - e[:, 0]).astype(np.float64) + step)])
        best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])  # of all runs that hold a token
        open_ = np.concatenate([[False], best + edge > -1e-3, [False]])
        # islands of tokens that may have other labels, within a sequence; on both sides stands O or the sequence's end
        on = open_[1:-1]
        begin = np.flatnonzero(on & (~open_[:-2] | (begins > 0)))
        if len(begin):
            last = np.concatenate([begins[1:] > 0, [True]])
            end = np.flatnonzero(on & (~open_[2:] | last))
            e[end] += np.where(last[end, None], 0.0, a[:, 0]).astype(np.float32)
            e[begin] += np.where(begins[begin, None] > 0, self._first(), a[0])
            order = np.argsort(begin - end, kind="stable")
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                self._viterbi(e, begin[own], (end - begin)[own] + 1, out)
        return out

    def _viterbi(self, e: np.ndarray, begin: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """The best labels of runs of tokens (longest first) into out; e has what their ends cost."""
        best, back = e[begin], []
        last = np.zeros(len(begin), np.uint8)
        for k in range(1, size[0]):
            n = np.searchsorted(-size, -k, "left")  # those that go on
            if n < len(best):
                last[n : len(best)] = best[n:].argmax(1)
            reach = best[:n, :, None] + self.pair
            from_ = reach.argmax(1)
            back.append(from_.astype(np.uint8))
            best = reach.max(1) + e[begin[:n] + k]
        last[: len(best)] = best.argmax(1)
        for k in range(size[0] - 1, -1, -1):
            n = np.searchsorted(-size, -k, "left")
            out[begin[:n] + k] = last[:n]
            if k:
                last[:n] = back[k - 1][np.arange(n), last[:n]]

    def _first(self) -> np.ndarray:
        return np.array([NEVER if x.startswith("I-") else 0.0 for x in self.labels], np.float32)


def labels_of(kinds: Sequence[str]) -> tuple[str, ...]:
    return ("O", *(f"{p}-{k}" for k in kinds for p in "BI"))


def _allowed(labels: Sequence[str]) -> np.ndarray:
    """NEVER where a further token would follow another kind."""
    return np.array([[NEVER if b[0] == "I" and a[2:] != b[2:] else 0.0 for b in labels] for a in labels])


def tagged(rows: Sequence[tuple[str, Sequence[tuple[str, int, int]]]], labels: Sequence[str]) -> tuple[Tokens, np.ndarray]:
    """Tokens of labelled texts (text, spans of kind, start and end in characters) and their labels."""
    raw = [text.encode() for text, _ in rows]
    first = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    t = tokens(np.frombuffer(b"".join(raw), np.uint8), first[:-1])
    y = np.zeros(len(t.start), np.int64)
    for (text, spans), at in zip(rows, first.tolist(), strict=False):
        for kind, s, e in spans:
            lo, hi = (at + len(text[:x].encode()) for x in (s, e))
            i, j = np.searchsorted(t.start, lo), np.searchsorted(t.start, hi)
            y[i:j] = labels.index(f"I-{kind}")
            y[i] = labels.index(f"B-{kind}")
    return t, y


def train(rows: Iterable[tuple[str, Sequence[tuple[str, int, int]]]], kinds: Sequence[str], epochs: int = 24, often: int = 4, rate: float = 0.1, decay: float = 2e-4, seed: int = 11) -> Field:
    """Weights of highest penalised likelihood, by Adam over batches of sequences of the labelled texts."""
    labels = labels_of(kinds)
    t, y = tagged(list(rows), labels)
    size_l = len(labels)
    seen, n = np.unique(t.word, return_counts=True)
    words = seen[(n >= often) & (seen != 0)]
    words = words if len(words) else np.zeros(1, U64)
    field = Field(labels, words, np.zeros((2 * REACH + 1, SHAPES, size_l)), np.zeros((2 * REACH + 1, len(words) + 1, size_l)), _allowed(labels))
    word, allowed, first = field.known(t.word), field.pair.copy(), field._first().astype(np.float64)
    ends = np.append(t.begins[1:], len(t.start))
    rng, groups = np.random.default_rng(seed), []
    order = np.argsort(ends - t.begins, kind="stable")
    for lo in range(0, len(order), 128):
        own = order[lo : lo + 128]
        length = (ends - t.begins)[own]
        k = np.arange(length.max())
        at = np.where(k < length[:, None], t.begins[own][:, None] + k, -1)
        near = np.pad(at, ((0, 0), (REACH, REACH)), constant_values=-1)
        windows = np.stack([near[:, o : o + len(k)] for o in range(2 * REACH + 1)])
        groups.append((at >= 0, np.where(windows >= 0, t.shape[windows], 0), np.where(windows >= 0, word[windows], 0), np.where(at >= 0, y[at], 0)))
    weights = [field.shape, field.word, field.pair]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            there, shape, near_word, gold = groups[g]
            grad = _gradient(weights, there, shape, near_word, gold, first)
            step += 1
            for w, (m, v), d in zip(weights, moments, grad, strict=True):
                d += decay * len(there) * w
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            weights[1][:, 0] = 0.0  # what is no known word says nothing
            weights[2][allowed < 0] = NEVER
    return Field(labels, words, weights[0].astype(np.float32), weights[1].astype(np.float32), weights[2].astype(np.float32))


def _gradient(weights: list[np.ndarray], there: np.ndarray, shape: np.ndarray, word: np.ndarray, gold: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Expected less observed counts of each weight, by forward and backward sums."""
    n, steps = there.shape
    size_l = len(first)
    e = sum(weights[0][o][shape[o]] + weights[1][o][word[o]] for o in range(2 * REACH + 1))
    e[:, 0] += first
    top = e.max(2, keepdims=True)
    p, a = np.exp(e - top), np.exp(weights[2])
    ahead, behind, scale = np.zeros_like(p), np.ones_like(p), np.ones((n, steps))
    for k in range(steps):
        x = p[:, k] if k == 0 else (ahead[:, k - 1] @ a) * p[:, k]
        scale[:, k] = x.sum(1)
        ahead[:, k] = x / scale[:, k, None]
        if k:
            off = ~there[:, k]
            ahead[off, k], scale[off, k] = ahead[off, k - 1], 1.0
    for k in range(steps - 2, -1, -1):
        x = (behind[:, k + 1] * p[:, k + 1]) @ a.T / scale[:, k + 1, None]
        behind[:, k] = np.where(there[:, k + 1, None], x, 1.0)
    here = ahead * behind
    here /= here.sum(2, keepdims=True)
    delta = here.copy()
    np.put_along_axis(delta, gold[..., None], np.take_along_axis(delta, gold[..., None], 2) - 1, 2)
    delta = delta[there]
    out = []
    for w, ids in ((weights[0], shape), (weights[1], word)):
        out.append(np.stack([np.stack([np.bincount(ids[o][there], delta[:, j], w.shape[1]) for j in range(size_l)], 1) for o in range(2 * REACH + 1)]))
    pairs = np.zeros((size_l, size_l))
    for k in range(1, steps):
        on = there[:, k]
        right = behind[on, k] * p[on, k]
        both = ahead[on, k - 1][:, :, None] * a * right[:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
        np.add.at(pairs, (gold[on, k - 1], gold[on, k]), -1)
    return [*out, pairs]
