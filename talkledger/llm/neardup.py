"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its five-word shingles. Two collections of ``m`` partial keys, each made of a
few minhashes, give m * m table keys by pairing: 2 * m * r minhashes do the work of m * m * 2r. The
second collection is read only for documents that share a partial key of the first, so most
documents stop there. Documents that meet in a table are candidates; candidates are compared by
their minhashes and confirmed on their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import fixed_numbers, long_lists, mixed, runs, stored, text_bytes, words

SHINGLE = 5
#: Partial keys in each collection and minhashes in a partial key. A pair of similarity 0.75 shares a
#: table with probability (1 - (1 - 0.75**2)**14)**2 = 0.99998.
KEYS, ROWS = 14, 2
#: Bins of the sample of a set that travels with it, and how many standard deviations below its
#: expectation a candidate may agree: 5 lose a pair at the very limit with probability 2e-6 (exact
#: binomial tails: 1.2e-6 by the minhashes, 5e-7 by the bins).
BINS, TOLERANCE = 256, 5.0
#: Shingles of the sets that a task keeps at hand while it compares pairs.
KEPT_SHINGLES = 4_000_000


def shingles(raw: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; shorter texts are one shingle, empty ones none."""
    tokens = words(raw)
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in tokens], dtype=np.uint64)
    width = min(size, len(tokens))
    n = len(tokens) - width + 1
    joined = np.full(n, width, np.uint64)
    for k in range(width):
        joined = mixed(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(joined)


def minhashes(values: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima of the set under as many fixed permutations of the 64-bit numbers."""
    flip, factor = fixed_numbers(count, 1)[:, None], fixed_numbers(count, 2)[:, None] | np.uint64(1)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 4096):
        part = values[None, at : at + 4096]
        least = np.minimum(least, ((part ^ flip) * factor).min(axis=1))
    return least


def _partial_keys(least: np.ndarray) -> np.ndarray:
    """2 * KEYS keys out of 2 * KEYS * ROWS minhashes; the place of a key is part of it."""
    rows = least.reshape(2 * KEYS, ROWS)
    keys = np.arange(1, 2 * KEYS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return keys


def _sample(values: np.ndarray, least: np.ndarray, keys: np.ndarray) -> bytes:
    """What candidates are compared by: low byte of every minhash, a byte for the smallest member of
    every bin (0: empty bin), half of every partial key, size of the set."""
    bins, first = np.unique(values >> np.uint64(56), return_index=True)
    marks = np.zeros(BINS, np.uint8)
    marks[bins.astype(np.int64)] = (values[first] & np.uint64(0xFFFF)) % np.uint64(255) + np.uint64(1)
    return (least & np.uint64(255)).astype(np.uint8).tobytes() + marks.tobytes() + keys.astype(np.uint32).tobytes() + np.uint32(len(values)).tobytes()


def _samples(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Minhash bytes, bin bytes, sizes and partial keys of packed samples."""
    hashes, end = 2 * KEYS * ROWS, 4 + 8 * KEYS
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, hashes + BINS + end)
    numbers = raw[:, -end:].copy().view(np.uint32)
    return [raw[:, :hashes], raw[:, hashes:-end], numbers[:, -1].astype(np.float64), numbers[:, :-1]]


def _plausible(percent: int, one, other) -> np.ndarray:
    """Whether pairs of samples may share ``percent`` % of their union.

    Sizes decide exactly. Minhashes and bins estimate the share; bins draw members of the union
    without replacement, so the estimate is the better the more of the union they hold.
    """
    (hash_a, bin_a, size_a), (hash_b, bin_b, size_b) = one[:3], other[:3]
    share = percent / 100
    good = np.minimum(size_a, size_b) >= share * np.maximum(size_a, size_b)
    n = hash_a.shape[-1]
    good &= (hash_a == hash_b).sum(axis=-1) >= n * share - TOLERANCE * np.sqrt(n * share * (1 - share))
    drawn = ((bin_a | bin_b) != 0).sum(axis=-1)
    same = ((bin_a == bin_b) & (bin_a != 0)).sum(axis=-1)
    union = np.maximum((size_a + size_b) / (1 + share), drawn)
    spread = np.sqrt(drawn * share * (1 - share) * np.maximum(union - drawn, 0) / np.maximum(union - 1, 1))
    return good & (same >= drawn * share - TOLERANCE * spread - 1)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_id", "n_shingles", "_set", "_first", "_second", "_marks"]
    for batch in batches:
        sizes, sets, first, second, marks = [], [], [], [], []
        for text in batch.column(1):
            values = shingles(text.as_py())
            sizes.append(len(values))
            if not len(values):
                sets.append(None)
                first.append(values), second.append(values), marks.append(b"")
                continue
            least = minhashes(values, 2 * KEYS * ROWS)
            keys = _partial_keys(least)
            sets.append(xxhash.xxh3_128_digest(values.tobytes()))
            first.append(keys[:KEYS]), second.append(keys[KEYS:])
            marks.append(_sample(values, least, keys))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), long_lists(first),
                long_lists(second), pa.array(marks, pa.binary()),
            ],
            names,
        )


def sketches(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Per row: id, set size, digest of the set (null: empty), partial keys, sample of the set."""
    return df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), text_bytes(text_column).alias("_raw")).mapInArrow(
        _sketched, "_id long, n_shingles long, _set binary, _first array<long>, _second array<long>, _marks binary"
    )


def _alike(percent: int):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that are worth comparing on full sets."""
        for batch in batches:
            if batch.num_rows:
                good = _plausible(percent, _samples(batch.column(2)), _samples(batch.column(3)))
                yield batch.select([0, 1]).filter(pa.array(good))

    return alike


def _across(percent: int):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Plausible pairs of one table entry that lie in different components.

        A pair that meets in several tables comes from the first of them.
        """
        for table in runs(batches, "_cell"):
            ids, comps = table.column("_id").to_numpy(), table.column("_comp").to_numpy()
            blocks, low, high = (table.column(c).to_numpy() for c in ("_block", "_low", "_high"))
            first, second = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
            samples = _samples(table.column("_marks"))
            sizes, keys = samples[2:]
            left, right = [], []
            for k in range(len(ids)):
                later = np.arange(k + 1, len(ids)) if low[k] == high[k] else np.flatnonzero(blocks > blocks[k])
                later = later[comps[later] != comps[k]]
                later = later[np.minimum(sizes[later], sizes[k]) * 100 >= percent * np.maximum(sizes[later], sizes[k])]
                if len(later):
                    later = later[_plausible(percent, [x[k] for x in samples], [x[later] for x in samples])]
                if len(later):
                    met = keys[later] == keys[k]
                    later = later[(met[:, :KEYS].argmax(axis=1) == first) & (met[:, KEYS:].argmax(axis=1) == second)]
                left.append(np.minimum(ids[k], ids[later]))
                right.append(np.maximum(ids[k], ids[later]))
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
            if pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return across


def _confirmed(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, np.ndarray] = {}
        room = KEPT_SHINGLES

        def of(raw: bytes) -> np.ndarray:
            nonlocal room
            if raw not in kept:
                values = shingles(raw)
                room -= len(values) + len(raw) // 8
                if room < 0:
                    kept.clear()
                    room = KEPT_SHINGLES
                kept[raw] = values
            return kept[raw]

        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                one, other = of(left.as_py()), of(right.as_py())
                shared = len(np.intersect1d(one, other, assume_unique=True))
                good.append(100 * shared >= percent * (len(one) + len(other) - shared))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return confirm


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets share ``percent`` % of their union; ``texts`` is (_doc, _raw)."""
    ends = pairs.select(F.col("a").alias("_end")).union(pairs.select("b")).distinct()
    texts = stored(texts.join(stored(ends, "ends"), F.col("_doc") == F.col("_end"), "left_semi"), "texts")
    left = texts.select(F.col("_doc").alias("_a"), F.col("_raw").alias("_left"))
    right = texts.select(F.col("_doc").alias("_b"), F.col("_raw").alias("_right"))
    both = pairs.join(right, F.col("b") == F.col("_b")).join(left, F.col("a") == F.col("_a")).select("a", "b", "_left", "_right")
    return stored(both.mapInArrow(_confirmed(percent), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(_node, _comp) of every node of the (a, b) links: the smallest node that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that label, so
    paths shrink geometrically. Labels are written each round; nothing but a count of changes
    reaches the driver.
    """
    both = stored(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_l")).select("_l.*").distinct(), "both")
    labels = stored(both.groupBy(F.col("a").alias("_node")).agg(F.least("_node", F.min("b")).alias("_comp")), "labels")
    while True:
        theirs = labels.select(F.col("_node").alias("_n"), F.col("_comp").alias("_c"))
        least = both.join(theirs, F.col("b") == F.col("_n")).groupBy("a").agg(F.min("_c").alias("_least"))
        near = stored(
            labels.join(least, F.col("_node") == F.col("a")).select("_node", "_comp", F.least("_comp", "_least").alias("_new")), "near"
        )
        jump = near.select(F.col("_node").alias("_n"), F.col("_new").alias("_c"))
        after = stored(
            near.join(jump, F.col("_new") == F.col("_n"), "left")
            .select("_node", F.coalesce("_c", "_new").alias("_new"), "_comp"), "labels",
        )
        changed = after.where("_new <> _comp").limit(1).count()
        labels = after.select("_node", F.col("_new").alias("_comp"))
        if not changed:
            return labels


def _tables(reps: DataFrame) -> DataFrame:
    """(_key, _id, _i, _j) of every table entry that a node may share with another node."""
    first = reps.select("_id", F.posexplode("_first").alias("_i", "_part"))
    shared = stored(first.groupBy("_part").agg(F.count("*").alias("_n")).where("_n > 1").select("_part"), "parts")
    kept = first.join(shared, "_part", "left_semi").groupBy(F.col("_id").alias("_doc")).agg(
        F.collect_set(F.struct("_i", "_part")).alias("_parts")
    )
    paired = reps.select("_id", "_second").join(kept, F.col("_id") == F.col("_doc"))
    entries = paired.select("_id", "_second", F.explode("_parts").alias("_p")).select("_id", "_p.*", F.posexplode("_second").alias("_j", "_other"))
    return entries.select(F.xxhash64("_part", "_other").alias("_key"), "_id", "_i", "_j")


def _cells(mixed_entries: DataFrame, block_rows: int) -> DataFrame:
    """Entries of a table key dealt to cells of two blocks at most, so that no key is one task's work."""
    x = mixed_entries.withColumn("_blocks", F.ceil(F.col("_n") / block_rows).cast("int"))
    x = x.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    x = x.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    x = x.withColumn("_low", F.least("_block", "_with")).withColumn("_high", F.greatest("_block", "_with"))
    return x.withColumn("_cell", F.xxhash64("_key", "_low", "_high"))


def _same_ids(sketch: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of every class and every id of several texts that is in it under a smaller id; an empty text counts."""
    marked = sketch.where("_id is not null").select("_id", F.xxhash64("_set").alias("_x"))
    several = marked.groupBy("_id").agg(F.min("_x").alias("_x"), F.max("_x").alias("_y")).where("_x <> _y")
    several = stored(several.select(F.col("_id").alias("_several")), "several")
    own = sketch.where("n_shingles > 0").select("_id", F.col("_set").alias("_own")).join(several, F.col("_id") == F.col("_several"), "left_semi")
    shared = classes.where("_copies > 1").select("_set", "_rep")
    return own.distinct().join(shared, F.col("_own") == F.col("_set")).where("_rep <> _id").select(F.col("_rep").alias("a"), F.col("_id").alias("b"))


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = 75, block_rows: int = 1_000
) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles``, ``component_id`` (smallest id reachable over links,
    itself included) and ``kept`` (id = component_id). Links need 100 * shared >= percent * union.

    Null, empty and blank texts have no shingles and are linked with nothing. Equal sets are one node
    from the start. Rows that share an id are one document: it is linked where any of its texts is.
    A row without an id cannot be named: its component is null and it is kept. Ids are integers.
    Long texts are used whole; empty tables give no rows. Of other columns nothing is read.
    """
    sketch = stored(sketches(df, id_column, text_column), "sketch")
    named = sketch.where("_id is not null and n_shingles > 0")
    classes = stored(named.groupBy("_set").agg(F.min("_id").alias("_rep"), F.count("*").alias("_copies")), "classes")
    reps = classes.select("_set", "_rep").join(
        named.select("_id", F.col("_set").alias("_own"), "_first", "_second", "_marks"), (F.col("_rep") == F.col("_id")) & (F.col("_set") == F.col("_own"))
    )
    # one row per node, but for ids that stand for several texts
    reps = stored(reps.select("_id", "_first", "_second", "_marks").dropDuplicates(["_id", "_marks"]), "nodes")
    entries = stored(_tables(reps), "entries")
    keys = stored(
        entries.groupBy("_key").agg(F.min("_id").alias("_lead"), F.max("_id").alias("_last"), F.count("*").alias("_n"))
        .where("_lead < _last").select("_key", "_lead", "_n"), "keys",
    )
    met = stored(entries.join(keys, "_key").select("_key", "_id", "_i", "_j", "_lead", "_n"), "met")
    marks = reps.select(F.col("_id").alias("_m"), "_marks")
    texts = df.select(F.col(f"`{id_column}`").cast("long").alias("_doc"), text_bytes(text_column).alias("_raw"))

    # first everything against the smallest id of its table entries: this alone joins most groups
    stars = stored(met.where("_lead <> _id").select(F.col("_lead").alias("a"), F.col("_id").alias("b")).distinct(), "stars")
    rated = (
        stars.join(marks.withColumnRenamed("_marks", "_right"), F.col("b") == F.col("_m")).drop("_m")
        .join(marks.withColumnRenamed("_marks", "_left"), F.col("a") == F.col("_m")).select("a", "b", "_left", "_right")
    )
    pairs = stored(rated.mapInArrow(_alike(percent), "a long, b long").distinct(), "pairs")
    links = stored(confirmed(pairs, texts, percent).union(_same_ids(sketch, classes)).distinct(), "links")
    near = components(links)

    # then entries that still span several components: all plausible pairs across them
    spread = met.join(near, F.col("_id") == F.col("_node"), "left").select(
        "_key", "_id", "_i", "_j", "_n", F.coalesce("_comp", "_id").alias("_comp")
    )
    spread = stored(spread, "spread")
    open_keys = spread.groupBy("_key").agg(F.min("_comp").alias("_x"), F.max("_comp").alias("_y")).where("_x < _y")
    open_keys = stored(open_keys.select(F.col("_key").alias("_k")), "open")
    cells = _cells(spread.join(open_keys, F.col("_key") == F.col("_k"), "left_semi"), block_rows)
    cells = cells.join(marks, F.col("_id") == F.col("_m")).select("_cell", "_id", "_comp", "_i", "_j", "_block", "_low", "_high", "_marks")
    cells = cells.repartition("_cell").sortWithinPartitions("_cell", "_id")
    rest = cells.mapInArrow(_across(percent), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti")
    rest = stored(rest, "rest")
    if rest.limit(1).count():
        more = confirmed(rest, texts, percent)
        if more.limit(1).count():
            near = components(links.unionByName(more))

    known = classes.where("_copies > 1").select(F.col("_set").alias("_s"), "_rep")
    nodes = stored(
        sketch.select("_id", "n_shingles", "_set").join(known, F.col("_set") == F.col("_s"), "left")
        .select("_id", "n_shingles", F.coalesce("_rep", "_id").alias("_rep")), "members",
    )
    found = nodes.join(near, F.col("_rep") == F.col("_node"), "left").select(
        "_id", "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_rep")).alias("_comp")
    )
    return found.select(
        F.col("_id").alias(id_column), "n_shingles", F.col("_comp").alias("component_id"),
        (F.col("_id").isNull() | (F.col("_id") == F.col("_comp"))).alias("kept"),
    )
