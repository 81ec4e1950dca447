"""Placement of documents on shards by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in its own order; shards take turns and each
claims the first slot on its walk that is still free. A document's key selects a slot and the slot
names the shard, so placement is one broadcast lookup, shares differ by one slot at most, and
adding or removing a shard moves few documents besides those it must.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that ``place`` broadcasts: about 16 bytes a slot.
MOST_SLOTS = 4_000_037


def prime_from(least: int) -> int:
    """The smallest prime that is not below ``least``."""
    n = max(2, least)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(shards: int, slots_per_shard: int = 100) -> int:
    return prime_from(shards * slots_per_shard + 1)


def _number(text: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{text}".encode()).hexdigest()[:15], 16)


def filled_table(shards: list[str], slots: int) -> list[int]:
    """The shard (place in ``shards``) of every slot. ``slots`` must be a prime."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and be different")
    if slots > MOST_SLOTS or slots < len(shards) or prime_from(slots) != slots:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    walk = [_number(s, "start") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table = [-1] * slots
    free = slots
    while free:
        for k in range(len(shards)):
            while table[walk[k]] >= 0:
                walk[k] = (walk[k] + step[k]) % slots
            table[walk[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int) -> Column:
    """First 15 hex digits of the key's MD5 modulo the table size; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def lookup_table(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) rows, one per slot of the table."""
    filled = ",".join(map(str, filled_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(filled), ",")).alias("slot", "_place"))
        .select(F.col("slot").cast("long"), F.get(names, F.col("_place").cast("int")).alias("shard"))
    )


def place(
    df: DataFrame, key: str = "doc_id", shards: list[str] | int = 64, slots: int | None = None,
    shard_column: str = "shard", slot_column: str = "slot",
) -> DataFrame:
    """``df`` with the slot and the shard of each row's key.

    Null keys are placed together as the empty text, equal keys always share a shard, text plays no
    part. Rows are neither added nor lost; an empty table stays empty. Columns of ``df`` named like
    the two results are replaced. The table has at most MOST_SLOTS rows, whatever the input, so it
    is broadcast; nothing is shuffled.
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    size = slots or table_size(len(names))
    table = lookup_table(df.sparkSession, names, size).select(
        F.col("slot").alias("__slot"), F.col("shard").alias("__shard")
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (shard_column, slot_column)]
    with_slot = df.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("__at"))
    joined = with_slot.join(F.broadcast(table), F.col("__at") == F.col("__slot"), "left")
    return joined.select(*kept, F.col("__at").alias(slot_column), F.col("__shard").alias(shard_column))


def write_shards(placed: DataFrame, path: str, parts: int = 16, key: str = "doc_id") -> None:
    """One folder per shard, each written by ``parts`` tasks so that no shard is one task's work."""
    part = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
