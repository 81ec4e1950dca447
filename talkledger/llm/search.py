"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. A block has one bit row per signature place, with a bit for each
of its documents; a term sets a few places for every level of its frequency that the document
reaches. The rows of a term's places, and-ed, show all documents that may hold the term that often,
and some that do not: with the weights of the terms their sums are upper bounds of the scores. A task
rescores, from the words themselves, every document whose bound does not prove it to be below the
best ones found so far, so what it keeps is exact; the best of all tasks are the result.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from talkledger.llm.common import mixed, stored, text_bytes

#: Frequencies that a signature tells apart; above the last every frequency is possible.
LEVELS = (1, 2, 3, 5, 9, 17)
#: Places of a term and level, and least number of places for each term and level of a document.
PROBES, PLACES = 3, 8
#: Limits of a block: documents, bits, bytes of text and places; bytes of all blocks that a task fills at a time.
BLOCK_DOCS, BLOCK_BITS, BLOCK_BYTES, HELD_BYTES = 1024, 1 << 24, 4 << 20, 16 << 20
#: Text bytes whose words are held as objects at a time.
PIECE_BYTES = 4 << 20
#: Terms of the items that one pass over the index answers, and documents rescored at a time.
PASS_TERMS, RESCORED = 50_000, 64
#: Tasks whose best rows are compared first.
NEIGHBOURS = 128

#: Term bytes stay, A-Z lower-cased; all others become blanks.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def blanked(raw: bytes) -> bytes:
    """The terms, lower-cased, with blanks between them."""
    return raw.translate(_TABLE)


def term_counts(blank: bytes, size: int = PIECE_BYTES) -> Counter:
    """How often each term stands in a blanked text."""
    counts, at = Counter(), 0
    while len(blank) - at > size:
        cut = blank.find(b" ", at + size)
        if cut < 0:
            break
        counts.update(blank[at:cut].split())
        at = cut
    counts.update(blank[at:].split())
    return counts


def _hashes(terms) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64)


def _places(hashes: np.ndarray, level: int, places: int) -> np.ndarray:
    """PROBES places of every term at a level; ``places`` is a power of two."""
    probes = np.arange(1 + level * PROBES, 1 + (level + 1) * PROBES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed(hashes[:, None] ^ probes) & np.uint64(places - 1)).astype(np.int64)


class _Block:
    """Documents that are to share a block."""

    def __init__(self, places: int):
        self.places, self.docs, self.texts, self.set_places, self.bytes = places, [], [], [], 0
        self.df: Counter = Counter()

    def add(self, doc, text: bytes, counts: Counter, hashes: np.ndarray, often: np.ndarray) -> None:
        at = [_places(hashes[often >= least], k, self.places).ravel() for k, least in enumerate(LEVELS)]
        self.docs.append((doc, int(often.sum())))
        self.texts.append(text)
        self.set_places.append(np.unique(np.concatenate(at)).astype(np.int32))
        self.df.update(counts.keys())
        self.bytes += len(text) + self.set_places[-1].nbytes

    def full(self) -> bool:
        n = len(self.docs)
        return n >= BLOCK_DOCS or n * self.places >= BLOCK_BITS or self.bytes >= BLOCK_BYTES

    def row(self) -> pa.RecordBatch:
        n = len(self.docs)
        bits = np.zeros((self.places, -(-n // 8)), np.uint8)
        for k, at in enumerate(self.set_places):
            bits[at, k >> 3] |= np.uint8(128 >> (k & 7))
        zstd = pa.Codec("zstd")
        values = [
            self.places, [d or 0 for d, _ in self.docs], [d is not None for d, _ in self.docs], [n for _, n in self.docs],
            bits.tobytes(), list(map(len, self.texts)), zstd.compress(b"".join(self.texts), asbytes=True), list(self.df), list(self.df.values()),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK.types)], schema=_BLOCK)


_BLOCK = pa.schema(
    [
        ("places", pa.int64()), ("ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())),
        ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()), ("terms", pa.list_(pa.binary())),
        ("counts", pa.list_(pa.int64())),
    ]
)
BLOCK = (
    "places long, ids array<long>, known array<boolean>, lengths array<long>, bits binary, sizes array<long>, texts binary, "
    "terms array<binary>, counts array<long>"
)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filling: dict[int, _Block] = {}
    held = 0
    for batch in batches:
        for doc, raw in zip(*batch.columns):
            text = blanked(raw.as_py())
            counts = term_counts(text)
            if not counts:
                continue
            often = np.fromiter(counts.values(), np.int64, len(counts))
            keys = sum(int((often >= least).sum()) for least in LEVELS)
            places = 1 << max(6, (keys * PLACES - 1).bit_length())
            block = filling.setdefault(places, _Block(places))
            held -= block.bytes
            block.add(doc.as_py(), text, counts, _hashes(counts), often)
            held += block.bytes
            if block.full() or held >= HELD_BYTES:
                most = places if block.full() else max(filling, key=lambda p: filling[p].bytes)
                held -= filling[most].bytes
                yield filling.pop(most).row()
    for block in filling.values():
        yield block.row()


def index(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of documents of like size: signatures by bit rows, term frequencies, terms.

    Documents without a term are not indexed. Equal ids and rows without an id are documents of their
    own. The text of a block is kept, blanked, for rescoring. Every document has at least eight places
    per term and level, so that a place that was not set proves that the term is absent.
    """
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), text_bytes(text_column).alias("_raw"))
    return stored(rows.mapInArrow(_indexed, BLOCK), "signatures")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, raw in zip(*batch.columns):
            terms = list(term_counts(blanked(raw.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["_item", "term"])


def weighted_terms(blocks: DataFrame, items: DataFrame, id_column: str, text_column: str, documents: int) -> DataFrame:
    """(_item, term, weight) of the items' distinct terms that documents hold and that weigh anything."""
    rows = items.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("_item"), text_bytes(text_column).alias("_raw")
    )
    asked = stored(rows.mapInArrow(_item_terms, "_item long, term binary").distinct(), "terms")
    held = blocks.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(df, "term").select("_item", "term", weight.alias("weight")).where("weight > 0")


class _Best:
    """The k best documents of every item so far: score down, then documents with an id first, id up."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.scores, self.ids, self.odd = (np.zeros((items, k), t) for t in (np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, odd: np.ndarray) -> None:
        rows = len(self.scores)
        scores = np.concatenate([self.scores, scores], 1)
        ids = np.concatenate([self.ids, np.broadcast_to(ids, (rows, len(ids)))], 1)
        odd = np.concatenate([self.odd, np.broadcast_to(odd, (rows, len(odd)))], 1)
        order = np.lexsort((ids, odd, -scores), axis=-1)[:, : self.k]
        self.scores, self.ids, self.odd = (np.take_along_axis(x, order, 1) for x in (scores, ids, odd))

    def possible(self, bounds: np.ndarray, ids: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Which documents may still be among the best, by upper bounds of their scores."""
        last, id_, odd_ = self.scores[:, -1:], self.ids[:, -1:], self.odd[:, -1:]
        before = (odd < odd_) | ((odd == odd_) & (ids < id_))
        return (bounds > last) | ((bounds == last) & (bounds > 0) & before)


class _Items:
    """Items of one pass: all their terms, and each item's places among them."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        rows = sorted(rows)
        weights = {term: weight for _, term, weight in rows}
        self.terms = {term: k for k, term in enumerate(weights)}
        self.weights = np.fromiter(weights.values(), np.int64, len(weights))
        self.ids = sorted({item for item, _, _ in rows})
        by_item = {item: [self.terms[t] for _, t, _ in g] for item, g in itertools.groupby(rows, lambda r: r[0])}
        self.flat = np.concatenate([by_item[i] for i in self.ids]).astype(np.int64)
        self.begins = np.cumsum([0, *(len(by_item[i]) for i in self.ids)])[:-1]
        self.hashes = _hashes(self.terms)

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """(items, documents) sums of the (terms, documents) parts of the items' terms."""
        return np.add.reduceat(parts[self.flat], self.begins, axis=0)


def _parts(weights: np.ndarray, often: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights[:, None] * ((1_000_000_000 * often) // (1000 * often + 20 * m))


def _bounds(items: _Items, bits: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores, (items, documents), from the bit rows of a block."""
    reached = np.zeros((len(items.hashes), n), np.int8)
    so_far = np.full((len(items.hashes), bits.shape[1]), 255, np.uint8)
    for level in range(len(LEVELS)):
        so_far &= np.bitwise_and.reduce(bits[_places(items.hashes, level, len(bits))], axis=1)
        if not so_far.any():
            break
        reached += np.unpackbits(so_far, axis=1, count=n).view(np.int8)
    # most often that a term can stand there, given the levels reached; 10**9 stands for any number
    most = np.array([0, *(k - 1 for k in LEVELS[1:]), 10**9], np.int64)
    value = (1_000_000_000 * most[:, None]) // (1000 * most[:, None] + 20 * m)
    value[-1] = 1_000_000
    bounds = np.zeros((len(items.ids), n), np.int64)
    for at in range(0, n, 256):
        part = slice(at, min(n, at + 256))
        level = reached[:, part].astype(np.intp)
        bounds[:, part] = items.scores(items.weights[:, None] * value[level, np.arange(part.start, part.stop)])
    return bounds


def _ranked(rows: list[tuple[int, bytes, int]], documents: int, length: int, k: int):
    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _Items(rows)
        best = _Best(len(items.ids), k)
        for batch in batches:
            for row in batch.to_pylist():
                _best_of_block(items, best, row, documents, length)
        found = best.scores > 0
        which, _ = np.nonzero(found)
        ids = pa.array(best.ids[found], pa.int64(), mask=best.odd[found])
        task = pa.array(np.full(len(which), TaskContext.get().partitionId() // NEIGHBOURS, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(items.ids, np.int64)[which]), task, ids, pa.array(best.scores[found])], ["_item", "_near", "_id", "score"]
        )

    return ranked


def _best_of_block(items: _Items, best: _Best, row: dict, documents: int, length: int) -> None:
    ids, odd = np.array(row["ids"], np.int64), ~np.array(row["known"], bool)
    n = len(ids)
    m = 50 + (50 * np.array(row["lengths"], np.int64) * documents) // length
    bits = np.frombuffer(row["bits"], np.uint8).reshape(row["places"], -1)
    bounds = _bounds(items, bits, n, m)
    texts, left = None, np.ones(n, bool)
    while True:
        possible = best.possible(bounds, ids, odd) & left
        hopeful = np.flatnonzero(possible.any(axis=0))
        if not len(hopeful):
            return
        # those first that exceed the most what is to be beaten
        lead = np.where(possible[:, hopeful], bounds[:, hopeful] - best.scores[:, -1:], -1).max(axis=0)
        chosen = hopeful[np.argsort(-lead, kind="stable")[:RESCORED]]
        if texts is None:
            raw = pa.Codec("zstd").decompress(row["texts"], sum(row["sizes"]), asbytes=True)
            ends = list(itertools.accumulate(row["sizes"]))
            texts = [raw[e - s : e] for s, e in zip(row["sizes"], ends)]
        often = np.zeros((len(items.terms), len(chosen)), np.int64)
        for at, doc in enumerate(chosen):
            counts = term_counts(texts[doc])
            few, many = (counts, items.terms) if len(counts) < len(items.terms) else (items.terms, counts)
            for term in few:
                if term in many:
                    often[items.terms[term], at] = counts[term]
        best.add(items.scores(_parts(items.weights, often, m[chosen])), ids[chosen], odd[chosen])
        left[chosen] = False


def search(
    df: DataFrame, items: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", pass_terms: int = PASS_TERMS,
) -> DataFrame:
    """The ``k`` best documents of every item: item, ``rank`` from 1, id, ``score`` above 0.

    A document's score is the sum over the item's distinct terms of
    weight * ((10**9 * tf) div (1000 * tf + 20 * m)), with m = 50 + (50 * its terms * documents) div
    (all terms); a term's weight is floor(1000 ln((2 documents + 2) / (2 df + 1))). Null and empty texts
    hold no term and do not count as documents. Equal scores rank by id, documents without an id last;
    rows that share an id are documents of their own. Items that share an id are one with all their
    terms; items without an id, without terms or with empty tables give no rows. Other columns are
    ignored; ids are cast to long. Items are answered in passes of about ``pass_terms`` terms, the only
    thing that is sent to every task; an item longer than that makes a pass of its own size. A very
    long document makes a block of its own.
    """
    blocks = index(df, id_column, text_column)
    totals = blocks.select(F.size("ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("l"))
    sums = totals.agg(F.sum("n").alias("documents"), F.sum("l").alias("length")).first()
    documents, length = sums.documents or 0, sums.length or 0
    weighted = stored(weighted_terms(blocks, items, item_column, item_text, documents), "weights")
    passes = max(1, -(-weighted.count() // pass_terms))
    read = blocks.select("places", "ids", "known", "lengths", "bits", "sizes", "texts")
    found = df.sparkSession.createDataFrame([], "_item long, _near long, _id long, score long")
    for p in range(passes):
        own = weighted.where(F.pmod(F.xxhash64("_item"), F.lit(passes)) == p) if passes > 1 else weighted
        rows = [(r._item, bytes(r.term), r.weight) for r in own.collect()]
        if rows:
            found = found.unionByName(read.mapInArrow(_ranked(rows, documents, length, k), "_item long, _near long, _id long, score long"))
    order = (F.desc("score"), F.asc_nulls_last("_id"))
    near = W.Window.partitionBy("_item", "_near").orderBy(*order)
    best = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(W.Window.partitionBy("_item").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("_item").alias(item_column), "rank", F.col("_id").alias(id_column), "score")
