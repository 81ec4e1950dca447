"""Removal of passages that an earlier document already holds, by Rabin-Karp hashes of word windows.

Every window of 50 words gets a rolling hash. Documents travel in blocks of some megabytes, each in a
packed row. Round one sends every block's distinct hashes, cut to a few more bits than it takes to
tell all windows of the input apart, to counters that deal with a range of hashes each; a block gets
one bit back for each: whether another block has it too. Round two sends, for those alone, 96 bits of
two independent hashes and the block's smallest document id, and gets back the windows of which some
other block holds an earlier document. The windows that are left over decide the words to remove;
windows that overlap merge into maximal intervals.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import mixed, pack, stored, text_bytes, unpack

#: Words of a window, text bytes of a block, text bytes for each counter of round one.
WINDOW, BLOCK_BYTES, COUNTER_BYTES = 50, 8 << 20, 8 << 20
#: Bits of a hash in round one beyond those of the number of text bytes: a window that repeats nowhere
#: is taken to round two with a probability of about 2**-SPARE_BITS.
SPARE_BITS = 8
#: Text bytes whose words are held as objects at a time.
PIECE_BYTES = 4 << 20
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def pieces(text: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes that cut no word."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def word_lanes(text: bytes) -> np.ndarray:
    """Two independent 64-bit hashes of every word."""
    digests = [b"".join(map(xxhash.xxh3_128_digest, part.split())) for part in pieces(text)]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def rolling(values: np.ndarray, base: int, window: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every ``window`` neighbours, bits mixed."""
    n = len(values) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    sums = np.cumsum(values * _powers(base, len(values)))
    spans = sums[window - 1 :].copy()
    spans[1:] -= sums[: n - 1]
    return mixed(spans * _powers(pow(base, -1, 1 << 64), n))


class Windows:
    """Places, documents and hashes of the windows of some texts put behind one another."""

    def __init__(self, texts: list[bytes], window: int, lanes: int = 2):
        words = [word_lanes(t) for t in texts]
        self.counts = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.counts)
        joined = np.concatenate(words) if words else np.empty((0, 2), np.uint64)
        document = np.repeat(np.arange(len(texts)), self.counts)
        self.places = np.flatnonzero(np.arange(len(joined)) + window <= self.ends[document]) if len(joined) else np.empty(0, np.int64)
        self.document = document[self.places]
        self.hashes = [rolling(np.ascontiguousarray(joined[:, k]), BASES[k], window)[self.places] for k in range(lanes)]


def pack_rising(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: the bytes of their differences, all lowest ones first, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_rising(blob: bytes) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Whole numbers, all lowest bytes first, compressed."""
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T))


def unpack_planes(blob: bytes, dtype) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


BLOCK = "block string, bytes long, ids array<long>, known array<boolean>, sizes array<long>, texts binary"


def _block_row(name: str, rows: list[tuple]) -> pa.RecordBatch:
    texts = [r[1] for r in rows]
    raw = b"".join(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name]), pa.array([len(raw)], pa.int64()), pa.array([[r[0] or 0 for r in rows]], pa.list_(pa.int64())),
            pa.array([[r[0] is not None for r in rows]], pa.list_(pa.bool_())), pa.array([list(map(len, texts))], pa.list_(pa.int64())),
            pa.array([pa.Codec("zstd").compress(raw, asbytes=True)], pa.binary()),
        ],
        ["block", "bytes", "ids", "known", "sizes", "texts"],
    )


def _blocked(block_bytes: int):
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k, text in zip(*batch.columns):
                held.append((k.as_py(), text.as_py()))
                size += len(held[-1][1])
                if size >= block_bytes:
                    yield _block_row(f"{task}-{count}", held)
                    count, held, size = count + 1, [], 0
        if held:
            yield _block_row(f"{task}-{count}", held)

    return blocked


def _texts(row: dict) -> list[bytes]:
    size = sum(row["sizes"])
    raw = pa.Codec("zstd").decompress(row["texts"], size, asbytes=True) if size else b""
    ends = itertools.accumulate(row["sizes"])
    return [raw[e - s : e] for s, e in zip(row["sizes"], ends)]


def _by_counter(sorted_hashes: np.ndarray, counters: int) -> list[tuple[int, slice]]:
    """The counters that hashes belong to, each with its part; a counter deals with a range of hashes."""
    owner = ((sorted_hashes >> np.uint64(32)) * np.uint64(counters)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(owner, prepend=owner[:1] - np.uint64(1))) if len(owner) else np.empty(0, np.int64)
    ends = [*cuts[1:].tolist(), len(owner)]
    return [(int(owner[a]), slice(a, b)) for a, b in zip(cuts.tolist(), ends)]


def _cut(windows: Windows, known: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct first hashes of the documents with an id, all but their first ``bits`` bits zero."""
    zeros = np.uint64(64 - bits)
    short = (windows.hashes[0] >> zeros) << zeros
    return short, np.unique(short[known[windows.document]])


def _sent(bits: int, counters: int, window: int):
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, own = _cut(Windows(_texts(row), window, 1), np.array(row["known"], bool), bits)
                parts = _by_counter(own, counters)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(parts), pa.string()), pa.array([c for c, _ in parts], pa.int64()),
                        pa.array([pack_rising(own[part]) for _, part in parts], pa.binary()),
                    ],
                    ["block", "counter", "keys"],
                )

    return sent


def _shared(group: pa.Table) -> pa.Table:
    """For every block, one bit per hash: whether another block has it."""
    keys = [unpack_rising(k.as_py()) for k in group["keys"]]
    _, back, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    marks = np.split(times[back] > 1, np.cumsum([len(k) for k in keys])[:-1])
    bits = pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())
    return pa.table({"block": group["block"], "counter": group["counter"], "bits": bits})


FOUND = (
    "kind int, block string, counter long, keys binary, checks binary, firsts binary, ids array<long>, sizes array<long>, texts binary, "
    "_id long, n_words long, n_removed long, kept_sha256 string"
)
_FOUND = pa.schema(
    [
        ("kind", pa.int32()), ("block", pa.string()), ("counter", pa.int64()), ("keys", pa.binary()), ("checks", pa.binary()),
        ("firsts", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary()),
        ("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ]
)
DONE, SENT, OPEN = 0, 1, 2


def _digest(words: Iterator[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _groups(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by both hashes, then id; where a new pair of hashes begins in it."""
    order = np.lexsort((ids, second, first))
    a, b = first[order], second[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _candidates(bits: int, counters: int, window: int):
    def candidates(group: pa.Table) -> pa.Table:
        """Documents that hold no repeated window are done; of the others the texts, and what to ask."""
        rows = group.to_pylist()
        own = next(r for r in rows if r["counter"] is None)
        texts, ids, known = _texts(own), np.array(own["ids"], np.int64), np.array(own["known"], bool)
        windows = Windows(texts, window)
        short, distinct = _cut(windows, known, bits)
        shared = np.zeros(len(distinct), bool)
        marks = {r["counter"]: r["bits"] for r in rows if r["counter"] is not None}
        for counter, part in _by_counter(distinct, counters):
            if counter in marks:
                shared[part] = np.unpackbits(np.frombuffer(marks[counter], np.uint8), count=part.stop - part.start)
        usable = known[windows.document]
        where = np.searchsorted(distinct, short[usable])
        document = windows.document[usable]
        # hashes that several documents of this block have
        low, high = np.full(len(distinct), len(texts)), np.full(len(distinct), -1)
        np.minimum.at(low, where, document)
        np.maximum.at(high, where, document)
        outside = shared[where]
        asked = outside | (low < high)[where]
        first, second = windows.hashes[0][usable][asked], windows.hashes[1][usable][asked] >> np.uint64(32)
        document, outside = document[asked], outside[asked]
        out = []
        order, begins = _groups(first, second, ids[document])
        begins = begins[outside[order][begins]]
        keys, checks, least = first[order][begins], second[order][begins], ids[document][order][begins]
        for counter, part in _by_counter(keys, counters):
            out.append(
                {
                    "kind": SENT, "block": own["block"], "counter": counter, "keys": pack_rising(keys[part]),
                    "checks": pack_planes(checks[part].astype(np.uint32)), "firsts": pack_planes(least[part]),
                }
            )
        is_open = np.zeros(len(texts), bool)
        is_open[document] = True
        for k in np.flatnonzero(~is_open):
            words = itertools.chain.from_iterable(p.split() for p in pieces(texts[k]))
            out.append(
                {
                    "kind": DONE, "_id": int(ids[k]) if known[k] else None, "n_words": int(windows.counts[k]), "n_removed": 0,
                    "kept_sha256": _digest(words),
                }
            )
        if is_open.any():
            left = [texts[k] for k in np.flatnonzero(is_open)]
            out.append(
                {
                    "kind": OPEN, "block": own["block"], "ids": ids[is_open].tolist(), "sizes": list(map(len, left)),
                    "texts": pa.Codec("zstd").compress(b"".join(left), asbytes=True),
                }
            )
        return pa.Table.from_pylist(out, _FOUND)

    return candidates


def _earlier(group: pa.Table) -> pa.Table:
    """For every block, those of its windows of which another block holds an earlier document."""
    keys = [unpack_rising(x.as_py()) for x in group["keys"]]
    checks = [unpack_planes(x.as_py(), np.uint32) for x in group["checks"]]
    ids = np.concatenate([unpack_planes(x.as_py(), np.int64) for x in group["firsts"]])
    order, begins = _groups(np.concatenate(keys), np.concatenate(checks), ids)
    sizes = np.diff(begins, append=len(order))
    later = np.empty(len(order), bool)
    later[order] = ids[order] > np.repeat(ids[order][begins], sizes)
    marks = np.split(later, np.cumsum([len(k) for k in keys])[:-1])
    return pa.table(
        {
            "block": group["block"], "counter": group["counter"],
            "keys": pa.array([pack_rising(k[m]) for k, m in zip(keys, marks)], pa.binary()),
            "checks": pa.array([pack_planes(c[m]) for c, m in zip(checks, marks)], pa.binary()),
        }
    )


def _answered(first: np.ndarray, second: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Whether each pair of hashes is among the sorted pairs (keys, checks)."""
    if not len(keys):
        return np.zeros(len(first), bool)
    at, end = np.searchsorted(keys, first, "left"), np.searchsorted(keys, first, "right")
    found = np.zeros(len(first), bool)
    for step in range(int((end - at).max(initial=0))):
        place = np.minimum(at + step, len(keys) - 1)
        found |= (at + step < end) & (checks[place] == second)
    return found


def _removed(window: int):
    def removed(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["counter"] is None)
        answers = sorted((r for r in rows if r["counter"] is not None), key=lambda r: r["counter"])
        keys = np.concatenate([np.empty(0, np.uint64), *(unpack_rising(r["keys"]) for r in answers)])
        checks = np.concatenate([np.empty(0, np.uint32), *(unpack_planes(r["checks"], np.uint32) for r in answers)])
        texts, ids = _texts(own), np.array(own["ids"], np.int64)
        windows = Windows(texts, window)
        first, second = windows.hashes[0], windows.hashes[1] >> np.uint64(32)
        mine = ids[windows.document]
        order, begins = _groups(first, second, mine)
        sizes = np.diff(begins, append=len(order))
        hit = _answered(first[order][begins], second[order][begins], keys, checks)
        gone = (mine[order] > np.repeat(mine[order][begins], sizes)) | np.repeat(hit, sizes)
        places = windows.places[order][gone]
        # windows that overlap or touch merge into one interval
        n = int(windows.counts.sum())
        covered = np.bincount(places, minlength=n + 1) - np.bincount(places + window, minlength=n + 1)
        covered = np.cumsum(covered)[:n] > 0
        out = []
        for k, (text, end, count) in enumerate(zip(texts, windows.ends.tolist(), windows.counts.tolist())):
            mask = covered[end - count : end]
            words = itertools.chain.from_iterable(p.split() for p in pieces(text))
            out.append((int(ids[k]), count, int(mask.sum()), _digest(itertools.compress(words, (~mask).tolist()))))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.Table.from_arrays(columns, ["_id", "n_words", "n_removed", "kept_sha256"])

    return removed


def without_repeats(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    counter_bytes: int = COUNTER_BYTES,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by a space.

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller id;
    windows are those of the input. Null and empty texts have no words; texts of fewer than ``window``
    words stay whole. Rows that share an id are texts of their own and remove nothing from each other;
    rows without an id stay whole and remove nothing. Repeats within one text alone stay. Empty tables
    give no rows, other columns are ignored, ids are cast to long. A very long text makes a block of its
    own and takes about fifteen times its bytes in the one task that has it. Windows count as equal by
    96 bits of two hashes.
    """
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), text_bytes(text_column).alias("_raw"))
    blocks = stored(rows.mapInArrow(_blocked(block_bytes), BLOCK), "blocks")
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    bits = min(64, max(40, size.bit_length() + SPARE_BITS))
    counters = max(16, size // counter_bytes)
    asked = blocks.mapInArrow(_sent(bits, counters, window), "block string, counter long, keys binary")
    shared = asked.groupBy("counter").applyInArrow(_shared, "block string, counter long, bits binary")
    parts = blocks.drop("bytes").unionByName(shared, allowMissingColumns=True)
    found = stored(parts.groupBy("block").applyInArrow(_candidates(bits, counters, window), FOUND), "windows")
    asked = found.where(F.col("kind") == SENT).select("block", "counter", "keys", "checks", "firsts")
    earlier = asked.groupBy("counter").applyInArrow(_earlier, "block string, counter long, keys binary, checks binary")
    still = found.where(F.col("kind") == OPEN).select("block", "ids", "sizes", "texts")
    result = "_id long, n_words long, n_removed long, kept_sha256 string"
    late = still.unionByName(earlier, allowMissingColumns=True).groupBy("block").applyInArrow(_removed(window), result)
    done = found.where(F.col("kind") == DONE).select("_id", "n_words", "n_removed", "kept_sha256")
    return done.unionByName(late).withColumnRenamed("_id", id_column)
