"""Language-model scores by context-tree weighting over bytes, beside a word-count baseline.

A byte is eight binary decisions; each decision has its own context tree over the bytes before it.
A node of a tree holds how often 0 and 1 followed its context in training; its Krichevsky-Trofimov
estimate is mixed half and half with the product of its children, from the longest contexts up to
none. The mixture weights that this gives decide how much each depth says about the next bit, so a
text's code length uses all depths at once.

Documents travel in blocks of some megabytes. A block sends its distinct words and byte strings,
packed, to the counters and gets one number back for each, so that neither counts nor model are
broadcast or held whole anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import pack, remainder, stored, text_bytes, unpack, words

#: Bytes of context, text bytes in a block, and divisor and remainder of what is held out.
DEPTH, BLOCK_BYTES, DIVISOR, HELD_OUT = 4, 12 << 20, 7, 2
#: Text bytes whose contexts a task works on at a time.
PIECE_BYTES = 1 << 20
#: UTF-8 holds no such byte: it ends a text, so that the chances of all texts sum to one.
END = b"\xff"
ODD = np.uint64(0x9E3779B97F4A7C15)
WORDS, GRAMS = 1, 2


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Evenly spread bucket of every key."""
    return ((keys * ODD) >> np.uint64(40)) % np.uint64(buckets)


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted 64-bit keys of the distinct tokens, the place of every token's key, tokens per text.

    Tokens are the lower-cased words and one end per text, whose key is that of the empty word.
    """
    index: dict[bytes, int] = {}
    places, counts = [], []
    for text in texts:
        tokens = words(text)
        tokens.append(b"")
        places.extend([index.setdefault(t, len(index)) for t in tokens])
        counts.append(len(tokens))
    raw = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in index), np.uint64, len(index))
    keys, back = np.unique(raw, return_inverse=True)
    return keys, back[np.array(places, np.int64)] if places else np.empty(0, np.int64), np.array(counts, np.int64)


def _codes(raw: np.ndarray, depth: int) -> np.ndarray:
    codes = np.zeros(max(0, len(raw) - depth), np.uint64)
    for k in range(depth + 1):
        codes = (codes << np.uint64(8)) | raw[k : len(raw) - depth + k]
    return codes


def gram_codes(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with the ``depth`` bytes before it as one number, and how many each text has.

    A text is lower-cased (A-Z), preceded by zero bytes and followed by END.
    """
    pad = b"\x00" * depth
    codes = _codes(np.frombuffer(b"".join(pad + t.lower() + END for t in texts), np.uint8), depth)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # what ends inside the zero bytes of the next text is no position
    real = np.ones(len(codes), bool)
    after = np.cumsum(sizes + depth)[:-1] - depth
    for k in range(depth):
        real[after + k] = False
    return codes[real], sizes


def gram_pieces(texts: list[bytes], depth: int = DEPTH, piece: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``gram_codes`` of some texts at a time, with the place of the first; a long text comes in several pieces."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) >= piece:
            yield first, *gram_codes(texts[first:k], depth)
            first, size = k, 0
        if len(text) >= piece:
            whole = np.frombuffer(b"\x00" * depth + text.lower() + END, np.uint8)
            for at in range(0, len(text) + 1, piece):
                codes = _codes(whole[at : at + piece + depth], depth)
                yield k, codes, np.array([len(codes)], np.int64)
            first = k + 1
        else:
            size += len(text) + 1
    if first < len(texts):
        yield first, *gram_codes(texts[first:], depth)


def gram_counts(texts: list[bytes], learned: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes of the texts and how often each stands in those to learn from."""
    found, counts = [], []
    for first, codes, sizes in gram_pieces(texts, depth):
        own, back = np.unique(codes, return_inverse=True)
        found.append(own)
        counts.append(np.bincount(back[np.repeat(learned[first : first + len(sizes)], sizes)], minlength=len(own)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, back = np.unique(np.concatenate(found), return_inverse=True)
    # float sums of counts are exact below 2**53
    return keys, np.bincount(back, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _block_rows(name: str, rows: list[tuple], buckets: int, depth: int) -> pa.RecordBatch:
    """One row with the block's documents; per kind and bucket one row of keys and training counts."""
    texts = [r[2] for r in rows]
    learned = np.array([not r[1] for r in rows], bool)
    keys, places, sizes = word_ids(texts)
    grams, n_grams = gram_counts(texts, learned, depth)
    out = [(name, 0, -1, pack(grams, True), None, pa.Codec("zstd").compress(b"".join(texts), asbytes=True))]
    for kind, own, n in (
        (WORDS, keys, np.bincount(places[np.repeat(learned, sizes)], minlength=len(keys)).astype(np.int64)),
        (GRAMS, grams, n_grams),
    ):
        bucket = buckets_of(own, buckets)
        for b in np.unique(bucket):
            chosen = bucket == b
            out.append((name, kind, int(b), pack(own[chosen], True), pack(n[chosen]), None))
    ids = pa.array([r[0] for r in rows], pa.int64())
    held = pa.array([r[1] for r in rows], pa.bool_())
    ends = pa.array([len(t) for t in texts], pa.int64())
    lists = [pa.array([x.to_pylist(), *[None] * (len(out) - 1)], t) for x, t in ((ids, pa.list_(pa.int64())), (held, pa.list_(pa.bool_())), (ends, pa.list_(pa.int64())))]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays([*columns, *lists], ["block", "kind", "bucket", "keys", "counts", "texts", "ids", "held", "sizes"])


BLOCKS = "block string, kind int, bucket int, keys binary, counts binary, texts binary, ids array<long>, held array<boolean>, sizes array<long>"


def _blocked(buckets: int, depth: int, block_bytes: int):
    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            ids, outside, raw = batch.columns
            for k in range(batch.num_rows):
                held.append((ids[k].as_py(), outside[k].as_py(), raw[k].as_py()))
                size += len(held[-1][2])
                if size >= block_bytes:
                    yield _block_rows(f"{task}-{count}", held, buckets, depth)
                    count, held, size = count + 1, [], 0
        if held:
            yield _block_rows(f"{task}-{count}", held, buckets, depth)

    return blocked


def _merged(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys of a bucket, their training counts, the place of every block's keys, block sizes."""
    keys = [unpack(k, np.uint64, True) for k in group["keys"]]
    counts = np.concatenate([unpack(c, np.int64) for c in group["counts"]])
    own, back = np.unique(np.concatenate(keys), return_inverse=True)
    # float sums of counts are exact below 2**53
    return own, np.bincount(back, weights=counts, minlength=len(own)).astype(np.int64), back, [len(k) for k in keys]


def _word_counts(group: pd.DataFrame) -> pd.DataFrame:
    _, sums, back, sizes = _merged(group)
    parts = np.split(sums[back], np.cumsum(sizes)[:-1])
    rows = [(b, WORDS, int(group["bucket"].iloc[0]), pack(p), None, None) for b, p in zip(group["block"], parts)]
    rows.append(("", 0, -1, None, int(sums.sum()), int((sums > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "values", "total", "known"])


def _gram_counts(group: pd.DataFrame) -> pd.DataFrame:
    keys, sums, _, _ = _merged(group)
    return pd.DataFrame({"bucket": group["bucket"].iloc[0], "gram": keys.view(np.int64), "n": sums})


def _gram_values(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """Log chances for every block's strings, in the order in which the block sent them."""
    if not len(own):
        return pd.DataFrame(columns=["block", "kind", "bucket", "values"])
    order = np.argsort(model["gram"].to_numpy())
    grams, chance = model["gram"].to_numpy()[order], model["chance"].to_numpy()[order]
    rows = []
    for block, bucket, keys in zip(own["block"], own["bucket"], own["keys"]):
        at = np.searchsorted(grams, unpack(keys, np.uint64, True).view(np.int64))
        rows.append((block, GRAMS, bucket, pack(chance[at])))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "values"])


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1/2: Stirling's series after eight steps up."""
    y = x + 8.0
    rise = F.lit(1.0)
    for k in range(8):
        rise = rise * (x + float(k))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + float(0.5 * np.log(2 * np.pi)) + series - F.log(rise)


def _estimate(n0: Column, n1: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov estimate of a sequence of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


def _half_sum(a: Column, b: Column) -> Column:
    """ln(exp(a)/2 + exp(b)/2)."""
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top)) - float(np.log(2))


def _bits(grams: DataFrame) -> DataFrame:
    """Each string's eight decisions: context, node of the byte's binary tree, and the bit."""
    symbol = F.col("gram").bitwiseAND(255)
    bits = grams.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    node = F.call_function("shiftright", F.lit(256).bitwiseOR(symbol).cast("long"), (F.lit(8) - F.col("_k")).cast("int"))
    bit = F.call_function("shiftright", symbol.cast("long"), (F.lit(7) - F.col("_k")).cast("int")).bitwiseAND(1)
    return bits.select("*", (F.shiftright("gram", 8) * 256 + node).alias("place"), bit.alias("bit"))


def gram_chances(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(bucket, gram, chance): log10 of the last byte's chance after the bytes before it.

    ``grams`` holds (bucket, gram, n) with training counts; strings that were never trained on have
    n = 0 and leave every tree as it is. A place is context * 256 + node, so the context one byte
    shorter is a remainder.
    """
    bits = _bits(grams)
    leaves = bits.groupBy("place").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).cast("double").alias("n0"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).cast("double").alias("n1"),
    )
    # bottom up: counts, own estimate and weighted chance of every node, per depth
    own = leaves.withColumn("own", _estimate(F.col("n0"), F.col("n1")))
    levels = {depth: stored(own.withColumn("all", F.col("own")), "contexts")}
    for d in range(depth - 1, -1, -1):
        shorter = levels[d + 1].groupBy((F.col("place") % (1 << (8 * d + 8))).alias("place")).agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("below")
        )
        own = shorter.withColumn("own", _estimate(F.col("n0"), F.col("n1")))
        own = own.withColumn("all", _half_sum(F.col("own"), F.col("below"))).drop("below")
        levels[d] = stored(own, "contexts")
    # top down: what the depths so far say of a 1, and the weight left for deeper ones
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    above = None
    for d in range(depth + 1):
        share = F.exp(F.col("own") - float(np.log(2)) - F.col("all")) if d < depth else F.lit(1.0)
        level = levels[d].select("place", one.alias("one"), share.alias("share"))
        if above is None:
            level = level.select("place", (F.col("share") * F.col("one")).alias("said"), (1 - F.col("share")).alias("left"))
        else:
            shorter = above.select(F.col("place").alias("_p"), "said", "left")
            level = level.join(shorter, F.col("place") % (1 << (8 * d)) == F.col("_p"))
            level = level.select(
                "place", (F.col("said") + F.col("left") * F.col("share") * F.col("one")).alias("said"),
                (F.col("left") * (1 - F.col("share"))).alias("left"),
            )
        above = level
    said = above.select(F.col("place").alias("_p"), "said")
    joined = bits.select("bucket", "gram", "place", "bit").join(said, F.col("place") == F.col("_p"))
    chance = F.log10(F.when(F.col("bit") == 1, F.col("said")).otherwise(1 - F.col("said")))
    return joined.groupBy("bucket", "gram").agg(F.sum(chance).alias("chance"))


def _answers(parts: pd.DataFrame, kind: int, keys: np.ndarray, buckets: int, dtype) -> np.ndarray:
    """The values a block got back, in the order of its sorted keys."""
    out, bucket = np.zeros(len(keys), dtype), buckets_of(keys, buckets)
    own = parts[parts["kind"] == kind]
    for b, blob in zip(own["bucket"], own["values"]):
        out[bucket == b] = unpack(blob, dtype)
    return out


def _scored(buckets: int, depth: int, total: int, known: int):
    def scored(group: pd.DataFrame) -> pd.DataFrame:
        row = group[group["kind"] == 0].iloc[0]
        sizes = np.array(row["sizes"], np.int64)
        joined = pa.Codec("zstd").decompress(row["texts"], int(sizes.sum()), asbytes=True) if sizes.sum() else b""
        ends = np.cumsum(sizes)
        texts = [joined[e - s : e] for s, e in zip(sizes, ends)]
        keys, places, counts = word_ids(texts)
        seen = _answers(group, WORDS, keys, buckets, np.int64)[places]
        grams = unpack(row["values"], np.uint64, True)
        chance = _answers(group, GRAMS, grams, buckets, np.float64)
        first = np.cumsum(counts) - counts
        by_text = np.zeros(len(texts))
        for k, codes, lengths in gram_pieces(texts, depth):
            by_text[k : k + len(lengths)] += np.add.reduceat(chance[np.searchsorted(grams, codes)], np.cumsum(lengths) - lengths)
        return pd.DataFrame(
            {
                "_id": pd.array([None if x is None or x != x else int(x) for x in row["ids"]], "Int64"), "held_out": np.array(row["held"], bool),
                "n_tokens": counts, "n_known": np.add.reduceat((seen > 0).astype(np.int64), first), "train_tokens": total,
                "base_score": np.add.reduceat(np.log10((seen + 1) / (total + known + 1)), first), "score": by_text,
                "n_bytes": sizes,
            }
        )

    return scored


def scores(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of ``df``: id, ``held_out`` (crc32 of the id as text modulo 7 is 2), ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` (add-one word model), ``score`` (log10 of the
    context-tree chance of the text and its end), ``bits_per_byte`` (the code length over bytes + 1).

    Both models learn from all documents that are not held out. Null texts count as empty: one end
    token. Rows without an id are learned from; equal ids are documents of their own; empty tables
    give no rows; without training documents every bit has chance 1/2. Long texts are whole and make
    a block of their own. Other columns are ignored. Words are counted by 64-bit hash.
    """
    spark = df.sparkSession
    buckets = buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(
        F.col(f"`{id_column}`").cast("long").alias("_id"), (remainder(id_column, DIVISOR) == HELD_OUT).alias("_held"), text_bytes(text_column).alias("_raw")
    )
    blocks = stored(rows.mapInArrow(_blocked(buckets, depth, block_bytes), BLOCKS), "blocks")
    sent = blocks.select("block", "kind", "bucket", "keys", "counts")
    counted = sent.where(F.col("kind") == WORDS).groupBy("bucket").applyInPandas(
        _word_counts, "block string, kind int, bucket int, values binary, total long, known long"
    )
    counted = stored(counted, "words")
    sums = counted.where("kind = 0").agg(F.sum("total").alias("total"), F.sum("known").alias("known")).first()
    total, known = sums.total or 0, sums.known or 0
    strings = sent.where(F.col("kind") == GRAMS)
    grams = stored(strings.groupBy("bucket").applyInPandas(_gram_counts, "bucket int, gram long, n long"), "grams")
    chances = stored(gram_chances(grams, depth), "chances")
    answers = strings.groupBy("bucket").cogroup(chances.groupBy("bucket")).applyInPandas(
        _gram_values, "block string, kind int, bucket int, values binary"
    )
    own = blocks.where("kind = 0").select("block", "kind", "bucket", F.col("keys").alias("values"), "texts", "ids", "held", "sizes")
    parts = own.unionByName(counted.where(F.col("kind") == WORDS).select("block", "kind", "bucket", "values"), True).unionByName(answers, True)
    result = "_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    scored = parts.groupBy("block").applyInPandas(_scored(buckets, depth, total, known), result)
    bits = -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)
    return scored.withColumn("bits_per_byte", bits).drop("n_bytes").withColumnRenamed("_id", id_column)
