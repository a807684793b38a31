"""Plain re-statements of operators over Python lists, to hold the distributed ones against."""

import itertools
import re
import zlib
from math import log

import numpy as np

SPACED = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaks(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def components(docs, width, part, whole):
    sets = []
    for _, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def toxicity(docs, labels, discount, pair_discount, top, vocabulary):
    """{id: score} of [(id, text)] by class-conditional Kneser-Ney bigrams, from dictionaries of strings."""
    words = {i: "".join(c if c.isalnum() and c < "\x80" or c > "\x7f" else " " for c in (t or "").lower()).split(" ") for i, t in docs}
    words = {i: [w for w in ws if w] for i, ws in words.items()}
    taught = {i: y for i, y in labels.items() if y is not None and i in words and zlib.crc32(str(i).encode()) % 5}
    count, pair, begun, lefts = ({}, {}), ({}, {}), ({}, {}), {}
    for i, y in taught.items():
        for w in set(words[i]):
            count[y][w] = count[y].get(w, 0) + 1
        for v, w in set(zip(words[i], words[i][1:])):
            pair[y][v, w] = pair[y].get((v, w), 0) + 1
            begun[y][v] = begun[y].get(v, 0) + 1
            lefts.setdefault(w, set()).add(v)
    whole = sum(map(len, lefts.values())) + 0.5 * max(vocabulary, len(count[0] | count[1]))
    total = [max(sum(c.values()), 1) for c in count]
    free = [max(sum(min(n, discount) for n in c.values()), 0.5) / t for c, t in zip(count, total)]
    kept = [{}, {}]
    for c in (0, 1):
        for (v, _), n in pair[c].items():
            kept[c][v] = kept[c].get(v, 0) + max(n - pair_discount, 0)

    def p(c, v, w, less):
        q = max(count[c].get(w, 0) - less - discount, 0) / total[c] + free[c] * (len(lefts.get(w, ())) + 0.5) / whole
        if v is None or not begun[c].get(v):
            return q
        seen = pair[c].get((v, w), 0)
        return max(seen - (less if max(pair[0].get((v, w), 0), pair[1].get((v, w), 0)) > pair_discount else 0) - pair_discount, 0) / begun[c][v] + (1 - kept[c][v] / begun[c][v]) * q

    def feature(i, without=None):
        r = [log(p(1, v, w, without == 1)) - log(p(0, v, w, without == 0)) for v, w in zip([None, *words[i]], words[i])]
        if not r:
            return 0.0, 0.0, 0.0
        return sum(r) / len(r), sum(sorted(r)[-top:]) / top, log(len(r) + 1)

    x, y = np.array([feature(i, y) for i, y in sorted(taught.items())]).reshape(-1, 3), np.array([float(y) for _, y in sorted(taught.items())])
    weights = logistic(x, y)
    return {i: float(1 / (1 + np.exp(-(np.dot(feature(i), weights[:-1]) + weights[-1])))) for i in words}


def logistic(x, y, ridge=1e-3):
    """Logistic regression by damped Newton steps, to the minimum of the penalised loss."""
    z = np.column_stack([x, np.ones(len(x))])
    penalty = ridge * len(y) * np.append(np.ones(x.shape[1]), 0)
    w = np.zeros(z.shape[1])

    def loss(w):
        s = z @ w
        return np.logaddexp(0, s).sum() - s @ y + (penalty * w * w).sum() / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-(z @ w)))
        step = np.linalg.lstsq((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-12), z.T @ (y - p) - penalty * w, rcond=None)[0]
        size = 1.0
        while size > 1e-9 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(step).max() < 1e-11:
            break
    return w
