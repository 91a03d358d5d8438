"""Plain-Python versions that operators are held against."""

import collections
import itertools
import math
import re
import zlib

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"


def rule_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


def shingles(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def brute_components(docs):
    """``{doc_id: (shingles, component)}`` over all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    comp = {i: i for i in sets}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
            lo, hi = sorted((find(a), find(b)))
            comp[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


def kn_ratios(docs, labels, d1=3.0, d2=256.0, telling=3):
    """``{doc_id: ratio, or None without words}``: interpolated Kneser-Ney of both classes, learnt from folds 2 to 4."""
    words = {i: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for i, t in docs.items()}
    pairs = [collections.Counter(), collections.Counter()]
    seen = set()
    for i in sorted(labels):
        # A text that repeats within a class counts once, in the fold of its least id.
        if i in docs and fold(i) and (docs[i], labels[i]) not in seen:
            seen.add((docs[i], labels[i]))
            if fold(i) != 1:
                pairs[labels[i]].update(zip([None, *words[i]], words[i]))
    conts = [collections.Counter(w for _, w in p) for p in pairs]
    totals = [sum(c.values()) for c in conts]
    kinds = len(set(conts[0]) | set(conts[1]))
    left = [sum(min(n, d1) for n in c.values()) / t for c, t in zip(conts, totals)]
    before = [collections.Counter(), collections.Counter()]
    lost = [collections.Counter(), collections.Counter()]
    for k in (0, 1):
        for (v, _), n in pairs[k].items():
            before[k][v] += n
            lost[k][v] += min(n, d2)

    def log_p(k, v, w):
        shared = (conts[0][w] + conts[1][w] + 1) / (sum(totals) + kinds + 1)
        p = max(conts[k][w] - d1, 0) / totals[k] + left[k] * shared
        if before[k][v]:
            p = max(pairs[k][v, w] - d2, 0) / before[k][v] + lost[k][v] / before[k][v] * p
        return math.log(p)

    out = {}
    for i, ws in words.items():
        each = sorted((log_p(1, v, w) - log_p(0, v, w) for v, w in zip([None, *ws], ws)), reverse=True)[:telling]
        out[i] = sum(each) / len(each) if each else None
    return out


def logistic_cut(ratios, labels, ridge=0.01):
    """Whether a document is toxic, by a logistic curve fitted to fold 1 by plain gradient steps."""
    train = [labels[i] for i in labels if fold(i)]
    prior = sum(train) / len(train)
    rows = [i for i in labels if fold(i) == 1 and ratios.get(i) is not None]
    x, y = np.array([ratios[i] for i in rows]), np.array([labels[i] for i in rows], float)
    z = (x - x.mean()) / x.std()
    w = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    a = b = 0.0
    for _ in range(200_000):
        q = 1 / (1 + np.exp(-(a + b * z)))
        g, h = (w * (q - y)).mean(), (w * (q - y) * z).mean() + ridge * b / len(z)
        a, b = a - 2.0 * g, b - 2.0 * h
        if abs(g) + abs(h) < 1e-7:
            break
    return lambda i: prior >= 0.5 if ratios[i] is None else a + b * (ratios[i] - x.mean()) / x.std() >= 0
