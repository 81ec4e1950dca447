"""Plain versions of what the operators promise, for small tables."""

import math
import zlib
from collections import Counter, defaultdict


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    """id -> smallest id reachable, for (id, text) rows; ids None are left out."""
    sets = defaultdict(list)
    for i, t in texts:
        if i is not None:
            sets[i].append(shingle_set(t))
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[a] < label[b] and any(
                    x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]
                ):
                    label[b], changed = label[a], True
    return label


def context_tree(train, depth):
    """Function that gives the log10 chance of a text."""
    def decisions(text):
        raw = b"\0" * depth + text.encode().lower() + b"\xff"
        for p in range(depth, len(raw)):
            node = 1
            for k in range(7, -1, -1):
                bit = raw[p] >> k & 1
                yield raw[p - depth : p], node, bit
                node = node * 2 + bit

    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    for text in train:
        for context, node, bit in decisions(text):
            for d in range(depth + 1):
                counts[d][context[depth - d :], node][bit] += 1
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    mixed = [{} for _ in counts]
    for d in range(depth, -1, -1):
        below = Counter()
        if d < depth:
            for (context, node), v in mixed[d + 1].items():
                below[context[1:], node] += v
        for key, n in counts[d].items():
            x = own(*n)
            mixed[d][key] = x if d == depth else math.log((math.exp(x - max(x, below[key])) + math.exp(below[key] - max(x, below[key]))) / 2) + max(x, below[key])

    def one(context, node, d=0):
        key = (context[depth - d :], node)
        if key not in counts[d]:
            return 0.5
        a, b = counts[d][key]
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        leaf = math.exp(own(a, b) - math.log(2) - mixed[d][key])
        return leaf * estimate + (1 - leaf) * one(context, node, d + 1)

    return lambda text: sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in decisions(text))


def isotonic(places, good, n):
    """Rising shares by the max-min formula, as (mean place, share) of every stretch of equal shares."""
    total = [sum(g for g in good[:k]) for k in range(len(good) + 1)]
    count = [sum(c for c in n[:k]) for k in range(len(n) + 1)]
    share = [
        max(min((total[j + 1] - total[i]) / (count[j + 1] - count[i]) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))
    ]
    out = []
    for k, value in enumerate(share):
        if out and abs(out[-1][1] - value) < 1e-12:
            out[-1][0].append(k)
        else:
            out.append(([k], value))
    return [sum(places[k] * n[k] for k in ks) / sum(n[k] for k in ks) for ks, _ in out], [v for _, v in out]


def quality_scores(rows, labels):
    """id -> score: cosine features, ridge over the labelled rows, isotonic over scores of other folds."""
    import numpy as np

    from talkledger.llm import quality as q

    marks = defaultdict(list)
    for i, x in labels:
        if x in (0, 1):
            marks[i].append(x)
    ids = [i for i, _ in rows]
    x = np.array([q.statistics((t or "").encode()) for _, t in rows], np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    n = np.array([len(marks[i]) for i in ids], float)
    good = np.array([sum(marks[i]) for i in ids], float)
    use = (fold > 0) & (n > 0)
    # statistics and features count in the operator's units, as whole numbers
    units = np.rint(x / q.STAT_UNIT)
    mean, spread = units[use].mean(0) * q.STAT_UNIT, units[use].std(0) * q.STAT_UNIT
    rng = np.random.default_rng(q.SEED)
    project = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], q.FEATURES))
    shift = rng.uniform(0, 2 * np.pi, q.FEATURES)
    z = np.sqrt(2) * np.cos(np.clip((x - mean) / np.where(spread > 1e-6, spread, 1), -5, 5) @ project + shift)
    z = np.hstack([np.rint(z / q.FEATURE_UNIT) * q.FEATURE_UNIT, np.ones((len(z), 1))])

    def fitted(chosen):
        a = (z[chosen] * n[chosen, None]).T @ z[chosen]
        shrink = np.eye(len(a)) * q.RIDGE * max(1.0, n[chosen].sum())
        shrink[-1, -1] = 1e-9
        return np.linalg.solve(a + shrink, z[chosen].T @ good[chosen])

    raw = z @ fitted(use)
    other = np.zeros(len(x))
    for f in set(fold[use].tolist()):
        other[fold == f] = z[fold == f] @ fitted(use & (fold != f))
    bins = (np.clip((other + 0.5) / 2, 0, 1) * q.BINS).astype(int)
    seen = sorted(set(bins[use].tolist()))
    places = [(b + 0.5) / q.BINS * 2 - 0.5 for b in seen]
    at, chance = isotonic(places, [good[use & (bins == b)].sum() for b in seen], [n[use & (bins == b)].sum() for b in seen])
    score = 0.999 * np.interp(raw, at, chance) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)
    return dict(zip(ids, score.tolist()))


def tilted_rates(sizes, target, most):
    """Expected copies 0..most of every size, tilted so that the words come to the target: the dual by halving."""
    def rate(m, size):
        top = max(0.0, m * size * most)
        mass = [math.exp(m * size * k - top) for k in range(most + 1)]
        return sum(k * x for k, x in enumerate(mass)) / sum(mass)

    if target >= most * sum(sizes) * (1 - 1e-12):
        return [most] * len(sizes)
    low, high = -50.0, 50.0
    for _ in range(200):
        m = (low + high) / 2
        low, high = (low, m) if sum(rate(m, s) * s for s in sizes) > target else (m, high)
    return [rate(m, s) for s in sizes]
