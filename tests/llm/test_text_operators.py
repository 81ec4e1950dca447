"""Spelling variants, repeated passages and lexical search against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from talkledger.llm import passages, search, variants

#: Columns whose names clash with inner ones.
SCHEMA = "doc_id long, text string, word string, block string, _raw int, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, "z") for i, t in rows], SCHEMA)


# --- repeated passages -----------------------------------------------------------


def plain_passages(rows, window):
    """(id, words, removed, digest) of every row, by looking at all windows of all rows."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(i, first.get(g, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passage_rows():
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(14)]
    rows = []
    for i in range(60):
        w = [rnd.choice("abcdefgh") + str(rnd.randint(0, 40)) for _ in range(rnd.randint(0, 50))]
        for _ in range(rnd.randint(0, 2)):
            a, n = rnd.randint(0, 8), rnd.randint(3, 14)
            w[rnd.randint(0, len(w)) : 0] = passage[a : a + n]
        rows.append((rnd.randint(0, 1000), rnd.choice([" ", "\n", "\t "]).join(w)))
    long = " ".join(f"w{k % 97}" for k in range(4000))
    copy = "one two three four five six seven eight"
    rows += [(5000, long), (5001, "x " + long), (2000, copy), (1999, copy), (1999, copy), (3000, copy.upper())]
    rows += [(None, copy), (None, None), (7, None), (8, ""), (9, " \x0b\x0c "), (-4, copy), (10, "é ü " * 7)]
    return rows


@pytest.mark.parametrize("window, block", [(5, 1 << 20), (5, 300), (1, 500), (50, 2000)])
def test_passages(spark, window, block):
    rows = passage_rows()
    got = passages.without_repeats(frame(spark, rows).repartition(5), window=window, block_bytes=block, counter_bytes=4000).collect()
    assert sorted(map(tuple, got), key=str) == plain_passages(rows, window)


def test_passages_of_empty_tables_and_long_words(spark):
    none = passages.without_repeats(frame(spark, []))
    assert none.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and none.count() == 0
    assert b"".join(passages.pieces(b"x" * 50, 10)) == b"x" * 50
    text = b" ".join(b"abc%d" % k for k in range(1000))
    assert [w for p in passages.pieces(text, 64) for w in p.split()] == text.split()


def test_rolling_hash_depends_on_the_window_alone():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 1 << 63, 200).astype(np.uint64), rnd.integers(0, 1 << 63, 90).astype(np.uint64)
    b[17:67] = a[100:150]
    one, two = passages.rolling(a, passages.BASES[0], 50), passages.rolling(b, passages.BASES[0], 50)
    assert set(one.tolist()) & set(two.tolist()) == {int(one[100])} == {int(two[17])}
    assert len(passages.rolling(a[:49], 3, 50)) == 0


def test_packed_numbers_come_back():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (passages.unpack_rising(passages.pack_rising(values)) == values).all()
    ids = np.array([-5, 0, 1 << 60], np.int64)
    assert (passages.unpack_planes(passages.pack_planes(ids), np.int64) == ids).all()
    assert len(passages.unpack_rising(passages.pack_rising(values[:0]))) == 0


# --- spelling variants -----------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if i is not None and (h := crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    forms = {}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        good = best is not None and words[best] >= 10 * words[w]
        forms[w] = (len(near), best if good else None, words[best] if good else None)
    out = []
    for w, (near, form, form_n) in forms.items():
        root = w
        while forms[root][1]:
            root = forms[root][1]
        out.append((w, words[w], near, form, form_n, root))
    return sorted(out)


def variant_rows():
    rnd = random.Random(11)
    stems = ["".join(rnd.choice("abcdeé×ÿ") for _ in range(rnd.randint(7, 10))) for _ in range(25)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 60)):
            x = list(rnd.choice(stems[: 1 + rnd.randint(0, 24)]))
            for _ in range(rnd.choice([0, 0, 0, 0, 1, 2])):
                at = rnd.randrange(len(x))
                x[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "é", "bb"])
            w.append("".join(x).upper() if rnd.random() < 0.1 else "".join(x))
        rows.append((i, rnd.choice([" ", "-", "\n", "1"]).join(w)))
    chain = ["abcdefg"] * 400 + ["abcdefh"] * 40 + ["abcdeih"] * 4
    anagrams = ["abcdefghij", "jihgfedcba", "bacdefghij"] * 3
    return rows + [(None, " ".join(chain)), (None, " ".join(anagrams)), (900, None), (901, ""), (902, "a" * 40 + " " + "a" * 41), (902, "a" * 40 + " " + "a" * 41)]


@pytest.mark.parametrize("cell, leaf, sample", [(8192, 96, 10**6), (40, 3, 10**6), (40, 5, 60)])
def test_variants(spark, cell, leaf, sample):
    rows = variant_rows()
    got = variants.variants(frame(spark, rows).repartition(4), cell=cell, leaf=leaf, sample=sample).collect()
    want = plain_variants(rows)
    assert sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got) == want
    assert {w[0]: w[5] for w in want}["abcdeih"] == "abcdefg" and sum(w[2] for w in want) > 100
    assert variants.variants(frame(spark, [])).count() == 0


def test_tree_reaches_all_that_are_near():
    rnd = np.random.default_rng(4)
    points = rnd.poisson(0.4, (600, variants.DIMENSIONS)).astype(np.int16)
    tree = variants.Tree(points, 10)
    home = tree.home(points)
    reached = np.zeros((tree.leaves, len(points)), bool)
    for leaf, at in tree.reach(points, 1, 1):
        assert not reached[leaf, at].any()
        reached[leaf, at] = True
    apart = points[:, None, :] - points[None, :, :]
    near = (np.maximum(apart, 0).sum(2) <= 1) & (np.maximum(-apart, 0).sum(2) <= 1)
    assert all(reached[home[b], a] for a, b in zip(*np.nonzero(near))) and reached.mean() < 0.6
    assert variants.Tree(points[:1].repeat(50, 0), 5).leaves == 1


# --- lexical search --------------------------------------------------------------


def plain_search(rows, items, k):
    def terms(t):
        return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    docs = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    df, length = Counter(x for _, c in docs for x in c), sum(sum(c.values()) for _, c in docs)
    asked = {}
    for item, t in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in docs:
            m = 50 + (50 * sum(c.values()) * len(docs)) // length
            score = sum(
                math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_rows():
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "中文", "it's", "A1"]
    rows = [(i, " ".join(rnd.choice(words[: rnd.randint(2, len(words))]) for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    rows += [(1000 + i, "w1 w2 w3 same text") for i in range(90)] + [(5, "w1 w1"), (5, "w1 w1"), (None, "w9 w9 w9 w50"), (None, None), (6, ""), (7, " .,- ")]
    rows += [(2000, "w40 " * 3000), (2001, " ".join(f"u{k}" for k in range(3000)) + " w41")]
    items = [(1, "w1 w2 w3"), (2, "W9, w50! w50"), (3, "中文 ünï absent"), (4, None), (5, ""), (None, "w1"), (6, "same"), (7, "w40 w41 u7"), (7, "w3"), (8, "nothing here")]
    return rows, items


@pytest.mark.parametrize("k, terms, docs", [(50, 50_000, 1024), (5, 3, 16)])
def test_search(spark, monkeypatch, k, terms, docs):
    monkeypatch.setattr(search, "BLOCK_DOCS", docs)
    rows, items = search_rows()
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = search.search(frame(spark, rows).repartition(3), asked, k=k, pass_terms=terms).collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, items, k)
    assert search.search(frame(spark, []), asked).count() == 0 and search.search(frame(spark, rows), asked.limit(0)).count() == 0


def test_bounds_are_never_below_scores():
    rows, items = search_rows()
    texts = [search.blanked((t or "").encode()) for _, t in rows]
    counts = [search.term_counts(t) for t in texts]
    block = search._Block(512)
    for k, (text, c) in enumerate(zip(texts, counts)):
        if c:
            block.add(k, text, c, search._hashes(c), np.fromiter(c.values(), np.int64, len(c)))
    row = block.row().to_pylist()[0]
    own = search._Items([(i, w, 1 + len(w)) for i, t in items if i is not None for w in search.term_counts(search.blanked((t or "").encode()))])
    bits, m = np.frombuffer(row["bits"], np.uint8).reshape(512, -1), 50 + np.array(row["lengths"])
    bounds = search._bounds(own, bits, len(row["ids"]), m)
    often = np.array([[counts[d][w] for d in row["ids"]] for w in own.terms])
    scores = own.scores(search._parts(own.weights, often, m))
    # signatures of 512 places are far too small for the long texts here: many bounds are loose, none is low
    assert (bounds >= scores).all() and (bounds > scores).any()
