"""Helpers that several operators share: written tables, word lists, packed arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger.session import shared_folder


def new_path(spark, name: str) -> str:
    """A path in the shared folder that no other job writes."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Cuts the lineage: what reads it survives the loss of any executor, and both sides of a later
    join start from plain scans, so that adaptive execution may split a hot key of either.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str) -> Column:
    """Whole text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; -1 without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % divisor, F.lit(-1)).cast("int")


def words(raw: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.split() cuts at is exactly this set."""
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fixed_numbers(count: int, seed: int) -> np.ndarray:
    """``count`` 64-bit numbers that depend on the seed alone."""
    steps = np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)
    return mixed(steps * np.uint64(0x9E3779B97F4A7C15))


def pack(values: np.ndarray, ordered: bool = False) -> bytes:
    """Compressed array; ``ordered`` stores the differences of rising integers."""
    if ordered:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(blob: bytes, dtype, ordered: bool = False) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    values = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), dtype=dtype)
    return np.cumsum(values, dtype=dtype) if ordered else values


def long_lists(rows: list[np.ndarray]) -> pa.Array:
    """List column of signed longs out of unsigned arrays."""
    flat = np.concatenate(rows).view(np.int64) if rows else np.empty(0, np.int64)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``, out of batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
