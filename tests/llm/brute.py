"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict
from math import exp, log

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, edges):
    """The smallest node that each reaches."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_documents(rows):
    """doc_id -> (size of its set, smallest doc_id of its group)."""
    sets = {i: shingles(t) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    edges = []
    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    both[j] += 1
        edges += [(i, j) for j, n in both.items() if 100 * n >= 75 * (len(s) + len(sets[j]) - n)]
    root = roots(list(sets), edges)
    return {i: (len(sets[i]), root[i]) for i in sets}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def without_repeats(rows, least=0):
    """doc_id -> (lines removed, text that is left); all earlier lines are compared."""
    seen, out = [], {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = (0, None)
            continue
        kept = []
        for raw in t.split("\n"):
            line = raw.strip(" ")
            if len(line) < max(1, least) or not any(one_edit(line, x) for x in seen):
                kept.append(raw)
            if len(line) >= max(1, least):
                seen.append(line)
        out[i] = (t.count("\n") + 1 - len(kept), "\n".join(kept))
    return out


def kneser_ney(texts, symbols, order):
    """A function from a text (a list of symbols) to its perplexity, by the formulas, with dictionaries."""
    levels = [None] * (order + 1)
    top = defaultdict(int)
    for s in texts:
        padded = [0] * (order - 1) + s
        for k in range(len(s)):
            top[tuple(padded[k : k + order])] += 1
    levels[order] = top
    for k in range(order - 1, 0, -1):
        below = defaultdict(int)
        for g in levels[k + 1]:
            below[g[1:]] += 1
        levels[k] = below
    cut, total, free = {}, {}, {}
    for k in range(1, order + 1):
        n = [sum(v == c for v in levels[k].values()) for c in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.75
        d = [1 - 2 * y * n[2] / n[1] if n[1] and n[2] else 0.75, 2 - 3 * y * n[3] / n[2] if n[2] and n[3] else 0.75, 3 - 4 * y * n[4] / n[3] if n[3] and n[4] else 0.75]
        cut[k] = [0] + [min(max(x, 0.01), c - 0.01) for c, x in enumerate(d, 1)]
        total[k], free[k] = defaultdict(float), defaultdict(float)
        for g, v in levels[k].items():
            total[k][g[:-1]] += v
            free[k][g[:-1]] += cut[k][min(v, 3)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / symbols
        low = p(g[1:])
        t = total[k].get(g[:-1], 0)
        if not t:
            return low
        v = levels[k].get(g, 0)
        return (max(v - cut[k][min(v, 3)], 0) + free[k][g[:-1]] * low) / t

    def perplexity(s):
        padded = [0] * (order - 1) + s
        return exp(-sum(log(p(tuple(padded[k : k + order]))) for k in range(len(s))) / len(s)) if s else None

    return perplexity
