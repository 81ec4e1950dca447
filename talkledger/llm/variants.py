"""Spelling variants by k-d trees over letter-count vectors.

One inserted or deleted letter changes a word's letter counts by one in all, a replaced one by two: one
up, one down. For every word length a k-d tree is fitted to a bounded sample and cuts the space of
counts into cells of some thousand words. Each word goes to the cell that holds it and, as a guest, to
every cell that one edit may reach; inside a cell a second tree prunes boxes in the same way down to
small leaves, where letter order decides. What meets is the words of one length, and those of a length
with those that are one shorter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import stored, text_bytes

#: Fewest code points and occurrences of a word, what a crc is divided by, and how much more often a form occurs.
LEAST, OFTEN, DIVISOR, TIMES = 7, 2, 31, 10
#: Words of a cell, of a leaf in a cell, and at most about so many that the trees are fitted to.
CELL, LEAF, SAMPLE = 8192, 96, 400_000
#: Distinct words that a task counts before it sends them on; text bytes held as words; words sent in a row.
HELD, PIECE_BYTES, ROUTED = 200_000, 4 << 20, 50_000
#: Pairs whose letters are compared at a time.
PAIRS = 1 << 18
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: A dimension for each of a-z; the other 64 letters share six, which can only bring vectors closer.
DIMENSIONS = 32
_CLASS = np.array([c - 97 if 97 <= c <= 122 else 26 + c % 6 for c in range(256)], np.int64)
_BIT = np.uint64(1) << np.array([c - 97 if 97 <= c <= 122 else 26 + c % 38 for c in range(256)], np.uint64)


def _pieces(raw: bytes) -> Iterator[bytes]:
    at = 0
    while len(raw) - at > PIECE_BYTES:
        cut = _BLANK.search(raw, at + PIECE_BYTES)
        if cut is None:
            break
        yield raw[at : cut.start()]
        at = cut.end()
    yield raw[at:]


def occurrences(doc: int | None, raw: bytes) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they stand in it, after the letters that the crc takes away."""
    prefix = None if doc is None else crc32(f"{doc}:".encode())
    for piece in _pieces(raw.lower()):  # bytes.lower() leaves all but A-Z
        for run, n in Counter(_RUN.findall(piece.decode("utf-8", "replace"))).items():
            if prefix is not None:
                h = crc32(run.encode(), prefix)
                if h % DIVISOR == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST:
                        continue
            yield run, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, int] = {}

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, raw in zip(*batch.columns):
            for word, n in occurrences(doc.as_py(), raw.as_py()):
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield batch_of()
                held.clear()
    if held:
        yield batch_of()


def vocabulary(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), text_bytes(text_column).alias("_raw"))
    counted = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("n") >= OFTEN), "vocabulary")


def letters(words: list[str]) -> np.ndarray:
    """Words of one length as rows of Latin-1 bytes, which sort as the words do."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letter counts of every word."""
    at = _CLASS[rows] + DIMENSIONS * np.arange(len(rows))[:, None]
    return np.bincount(at.ravel(), minlength=DIMENSIONS * len(rows)).reshape(-1, DIMENSIONS).astype(np.int16)


def marks(rows: np.ndarray) -> np.ndarray:
    """One bit per letter, set where the letter stands an odd number of times."""
    return np.bitwise_xor.reduce(_BIT[rows], axis=1) if len(rows) else np.empty(0, np.uint64)


class Tree:
    """A k-d tree: at each inner node the dimension and count whose cut parts the points most evenly."""

    def __init__(self, points: np.ndarray, capacity: int):
        self.dimension, self.at, self.low, self.high, self.box = [], [], [], [], []
        self.leaves = 0
        limits = np.full(points.shape[1], -1, np.int16), np.full(points.shape[1], 1 << 14, np.int16)
        self._grow(points, max(1, capacity), *limits)

    def _grow(self, points: np.ndarray, capacity: int, lower: np.ndarray, upper: np.ndarray) -> int:
        node = len(self.at)
        for part in (self.dimension, self.at, self.low, self.high):
            part.append(-1)
        self.box.append((lower, upper))
        cut = self._cut(points) if len(points) > capacity else None
        if cut is None:
            self.low[node], self.leaves = self.leaves, self.leaves + 1
            return node
        d, t = cut
        left = points[:, d] <= t
        below, above = upper.copy(), lower.copy()
        below[d], above[d] = t, t + 1
        self.dimension[node], self.at[node] = d, t
        self.low[node] = self._grow(points[left], capacity, lower, below)
        self.high[node] = self._grow(points[~left], capacity, above, upper)
        return node

    @staticmethod
    def _cut(points: np.ndarray) -> tuple[int, int] | None:
        top = int(points.max())
        if top == 0:
            return None
        # share of the points at or below every count, per dimension
        shares = np.stack([(points <= t).mean(axis=0) for t in range(top)], axis=1)
        uneven = np.abs(shares - 0.5)
        d, t = np.unravel_index(int(uneven.argmin()), uneven.shape)
        return None if shares[d, t] in (0.0, 1.0) else (int(d), int(t))

    def reach(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points) for all leaves whose box is at most ``up`` letters more and ``down`` fewer away."""
        none = np.zeros(len(points), np.int16)
        stack = [(0, np.arange(len(points)), none, none)]
        while stack:
            node, rows, more, fewer = stack.pop()
            if not len(rows):
                continue
            d, t = self.dimension[node], self.at[node]
            if d < 0:
                yield self.low[node], rows
                continue
            x, (lower, upper) = points[rows, d], self.box[node]
            less = fewer + np.maximum(x - t, 0) - np.maximum(x - upper[d], 0)
            near = less <= down
            stack.append((self.low[node], rows[near], more[near], less[near]))
            extra = more + np.maximum(t + 1 - x, 0) - np.maximum(lower[d] - x, 0)
            near = extra <= up
            stack.append((self.high[node], rows[near], extra[near], fewer[near]))

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for leaf, rows in self.reach(points, 0, 0):
            out[rows] = leaf
        return out


def fitted(words: DataFrame, cell: int, sample: int) -> tuple[dict[int, Tree], dict[int, int]]:
    """A tree for every word length, and the number of its first cell, from about ``sample`` words at most."""
    sizes = {r.k: r.n for r in words.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = min(1.0, sample / max(1, sum(sizes.values())))
    chosen = words if share == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    by_length: dict[int, list[str]] = {k: [] for k in sizes}
    for row in chosen.select("word").toLocalIterator():
        by_length[len(row.word)].append(row.word)
    trees, first, number = {}, {}, 0
    for k in sorted(sizes):
        own = sorted(by_length[k])
        points = vectors(letters(own)) if own else np.zeros((0, DIMENSIONS), np.int16)
        trees[k], first[k] = Tree(points, int(cell * share)), number
        number += trees[k].leaves
    return trees, first


def _routed(trees: dict[int, Tree], first: dict[int, int]):
    """Words packed per cell; guests of their own length only where the cell comes after their own."""
    names = ["cell", "guest", "length", "letters", "counts"]
    kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]

    def parts(words: list[str], counts: np.ndarray) -> Iterator[tuple]:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.unique(lengths).tolist():
            chosen = np.flatnonzero(lengths == k)
            rows, n = letters([words[i] for i in chosen]), counts[chosen]
            points = vectors(rows)
            home = trees[k].home(points)
            for leaf, at in trees[k].reach(points, 1, 1):
                for guest, own in ((False, at[home[at] == leaf]), (True, at[home[at] < leaf])):
                    if len(own):
                        yield first[k] + leaf, guest, k, rows[own].tobytes(), n[own].tobytes()
            for leaf, at in trees[k + 1].reach(points, 1, 0) if k + 1 in trees else ():
                yield first[k + 1] + leaf, True, k, rows[at].tobytes(), n[at].tobytes()

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []

        def packed() -> pa.RecordBatch:
            out = zip(*parts(words, np.array(counts, np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

        for batch in batches:
            words += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            if len(words) >= ROUTED:
                yield packed()
                words.clear(), counts.clear()
        if words:
            yield packed()

    return routed


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``b``, one letter longer, is ``a`` with a letter put in."""
    ahead, behind = a == b[:, :-1], a == b[:, 1:]
    n = a.shape[1]
    begin = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1))
    end = np.where(behind.all(axis=1), n, behind[:, ::-1].argmin(axis=1))
    return begin + end >= n


def _close(points: np.ndarray, own: np.ndarray, tree: Tree, members: list[np.ndarray], base: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, member) pairs that differ by one edit. ``base``: the first member that a point may meet."""
    odd, own_odd = marks(points), marks(own)
    check = one_replaced if same else one_inserted
    for leaf, at in tree.reach(vectors(points), 1, int(same)):
        inside = members[leaf]
        step = max(1, PAIRS // len(inside))
        for k in range(0, len(at), step):
            some = at[k : k + step]
            apart = np.bitwise_count(odd[some][:, None] ^ own_odd[inside][None, :])
            left, right = np.nonzero((apart <= 2) & (inside[None, :] >= base[some][:, None]))
            left, right = some[left], inside[right]
            good = check(points[left], own[right])
            yield left[good], right[good]


def _near(leaf_words: int):
    def near(group: pa.Table) -> pa.Table:
        """How many near words each word of a cell has there, and which of them is the most frequent."""
        parts: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray]] = {}
        rows = group.to_pylist()
        for key in {(r["guest"], r["length"]) for r in rows}:
            mine = [r for r in rows if (r["guest"], r["length"]) == key]
            text = np.frombuffer(b"".join(r["letters"] for r in mine), np.uint8).reshape(-1, key[1])
            parts[key] = text, np.frombuffer(b"".join(r["counts"] for r in mine), np.int64)
        length = next((k for guest, k in parts if not guest), None)
        out = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.int64()), ("form", pa.string())])
        if length is None:
            return out.empty_table()
        own = parts[False, length][0]
        # members of a leaf lie side by side: a word of the cell meets those after it
        tree = Tree(vectors(own), leaf_words)
        order = np.argsort(tree.home(vectors(own)), kind="stable")
        own, own_n = own[order], parts[False, length][1][order]
        home = tree.home(vectors(own))
        members = np.split(np.arange(len(own)), np.searchsorted(home, np.arange(1, tree.leaves)))
        texts, counts, left, right, offset = [own], [own_n], [], [], len(own)
        for a, b in _close(own, own, tree, members, np.arange(1, len(own) + 1), True):
            left.append(a), right.append(b)
        for (guest, k), (text, n) in sorted(parts.items()):
            if guest:
                for a, b in _close(text, own, tree, members, np.zeros(len(text), np.int64), k == length):
                    left.append(a + offset), right.append(b)
                texts.append(text), counts.append(n)
                offset += len(text)
        n = np.concatenate(counts)
        names = np.concatenate([np.ascontiguousarray(t).view(f"S{t.shape[1]}").ravel() for t in texts])
        place = np.empty(len(n), np.int64)
        place[best_first := np.lexsort((names, -n))] = np.arange(len(n))
        a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
        near_counts = np.bincount(a, minlength=len(n)) + np.bincount(b, minlength=len(n))
        best = np.full(len(n), len(n))
        np.minimum.at(best, a, place[b])
        np.minimum.at(best, b, place[a])
        found = np.flatnonzero(near_counts)
        form = best_first[best[found]]
        words = [pa.array([w.decode("latin-1") for w in names[x].tolist()], pa.string()) for x in (found, form)]
        return pa.Table.from_arrays([words[0], pa.array(near_counts[found]), pa.array(n[form]), words[1]], schema=out)

    return near


def near_words(words: DataFrame, cell: int = CELL, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(word, n_near, n of the most frequent near word, that word) of the words that have near ones.

    ``words`` holds distinct (word, n) of letters up to U+00FF. Ties go to the smaller word. Cells are about
    ``cell`` words, so that no task depends on how frequent a word or how common its letters are; words
    with the same letters cannot be parted and share a cell.
    """
    trees, first = fitted(words, cell, sample)
    routed = words.select("word", "n").mapInArrow(_routed(trees, first), "cell long, guest boolean, length int, letters binary, counts binary")
    near = routed.groupBy("cell").applyInArrow(_near(leaf), "word string, near long, best long, form string")
    best = F.min(F.struct((-F.col("best")).alias("n"), F.col("form").alias("form")))
    found = near.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best"), F.col("b.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form of every chain. Steps double, chains have no circles."""
    ends = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = stored(ends.join(further, "root", "left"), "roots")
        ends = joined.select("word", F.coalesce("_next", "root").alias("root"))
        if joined.where(F.col("_next").isNotNull()).isEmpty():
            return ends


def variants(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", cell: int = CELL, leaf: int = LEAF, sample: int = SAMPLE, times: int = TIMES
) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (null: none), ``root``.

    Words are runs of letters up to U+00FF with A-Z lower-cased; where 31 divides the crc32 of
    ``<id>:<run>`` one letter is taken out. Null and empty texts have none; texts without an id are counted
    as they are, since there is no id to take a crc of; equal rows count as often as they stand. A form is the
    most frequent near word (ties: the smaller), if it occurs at least ``times`` as often as the word; with
    ``times`` above 1 chains of forms end. An empty table gives no rows, other columns are ignored, ids are
    cast to long. Very long texts are read in pieces.
    """
    words = vocabulary(df, id_column, text_column)
    near = near_words(words, cell, leaf, sample)
    rows = words.join(near, "word", "left")
    is_form = F.col("best") >= times * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("best")).alias("form_n"),
    )
    rows = stored(rows, "variants")
    last = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
