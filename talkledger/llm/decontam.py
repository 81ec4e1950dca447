"""Benchmark decontamination by spaced-seed hashing.

A window of 13 words of a document is an overlap with a benchmark item if it agrees with 13
consecutive words of the item in at least 11 places. Two fixed masks read 6 of 10 and 6 of 11
neighbouring words. Take the places of a window modulo 4: two substitutions spoil two of the four
classes at most, and the two clean classes are neighbours (the first mask, at a shift of 0 to 3) or
opposite (the second, at a shift of 0 or 1). So every overlap holds a hit of a mask, and the words
around the hit decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window and substitutions it may hold.
WINDOW, SUBSTITUTIONS = 13, 2
#: Places that the masks read, counted from the place of the hit.
MASKS = ((0, 1, 4, 5, 8, 9), (0, 2, 4, 6, 8, 10))
#: A mask of span 10 lies in windows that begin up to 3 places earlier, one of span 11 up to 2.
BEFORE = tuple(WINDOW - 1 - max(m) for m in MASKS)
SPAN = range(-max(BEFORE), WINDOW)


def word_hashes(text: Column) -> Column:
    """Hash of every word (run of letters and digits, lower case) of the whole text; null: none."""
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _places(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """One row per word with the hashes of the words around it (null beyond the ends)."""
    hashes, before = F.col("_words"), -SPAN.start
    padded = F.concat(F.array_repeat(F.lit(None).cast("long"), before), hashes)
    columns = [
        F.slice(padded, k - SPAN.start + 1, F.greatest(F.size(hashes), F.lit(1))).alias(f"{prefix}{k - SPAN.start}") for k in SPAN
    ]
    around = df.where(F.size(hashes) > 0).select(*keep, F.posexplode(F.arrays_zip(*columns)).alias(f"{prefix}place", "_z"))
    return around.select(*keep, f"{prefix}place", "_z.*").where(F.col(f"{prefix}{before}").isNotNull())


def _at(prefix: str, k: int) -> Column:
    return F.col(f"{prefix}{k - SPAN.start}")


def _seeds(prefix: str, least: list[int]) -> Column:
    """(mask, hash) of every mask that fits here; short items are masks of their own length."""
    read = [list(m) for m in MASKS] + [list(range(n)) for n in least]
    return F.array(*[
        F.when(_at(prefix, places[-1]).isNotNull(), F.xxhash64(F.lit(k), *[_at(prefix, p) for p in places]))
        for k, places in enumerate(read)
    ])


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", most_broadcast: int = 2_000_000,
) -> DataFrame:
    """(id, item, ``agreeing``, ``place``) of every document that overlaps with an item.

    ``agreeing`` is the largest number of equal words in an overlap, ``place`` the first word (from 0)
    of the first overlap in the document. Items of fewer than 13 words must occur whole and without
    substitution. Null, empty and blank texts on either side overlap with nothing; rows that agree in
    id (or item) are one document (or item), and a null id is returned as null. Texts are used whole;
    other columns are ignored; empty tables give no rows. The seeds of the benchmark are counted and
    broadcast up to ``most_broadcast`` rows (about 200 bytes each); beyond that Spark joins by shuffles.
    """
    items = benchmark.select(
        F.col(f"`{item_column}`").alias("_item"), word_hashes(F.col(f"`{item_text_column}`")).alias("_words")
    ).withColumn("_size", F.size("_words"))
    short = sorted(r[0] for r in items.where(f"_size between 1 and {WINDOW - 1}").select("_size").distinct().collect())
    tests = _places(items, ["_item", "_size"], "t")
    kinds = len(MASKS)
    wanted = F.when(F.col("_mask") < kinds, F.col("_size") >= WINDOW)
    for k, n in enumerate(short):
        wanted = wanted.when(F.col("_mask") == kinds + k, (F.col("_size") == n) & (F.col("tplace") == 0))
    around = [f"t{k - SPAN.start}" for k in SPAN]
    tests = (
        tests.select("_item", "_size", "tplace", *around, F.posexplode(_seeds("t", short)).alias("_mask", "_seed"))
        .where(F.col("_seed").isNotNull() & wanted)
    )
    if tests.limit(most_broadcast + 1).count() <= most_broadcast:
        tests = F.broadcast(tests)

    training = _places(
        docs.select(F.col(f"`{id_column}`").alias("_id"), word_hashes(F.col(f"`{text_column}`")).alias("_words")), ["_id"], "d"
    )
    seeds = training.select("*", F.explode(_seeds("d", short)).alias("_look"))
    hits = seeds.join(tests, F.col("_look") == F.col("_seed"))
    equal = {k: F.when(_at("d", k) == _at("t", k), 1).otherwise(0) for k in SPAN}
    inside = {k: _at("d", k).isNotNull() & _at("t", k).isNotNull() for k in (*range(SPAN.start, 1), *range(WINDOW - 1 + SPAN.start, WINDOW))}
    windows = [
        F.when(
            inside[begin] & inside[begin + WINDOW - 1],
            F.struct(sum((equal[begin + k] for k in range(1, WINDOW)), equal[begin]).alias("_agree"), (F.col("dplace") + begin).alias("_from")),
        )
        for begin in range(SPAN.start, 1)
    ]
    whole = F.struct(F.col("_size").alias("_agree"), F.col("dplace").alias("_from"))
    checked = hits.select("_id", "_item", F.explode(F.when(F.col("_mask") < kinds, F.array(*windows)).otherwise(F.array(whole))).alias("_w"), "_mask")
    good = checked.where(f"_w is not null and (_mask >= {kinds} or _w._agree >= {WINDOW - SUBSTITUTIONS})")
    return good.groupBy(F.col("_id").alias(id_column), F.col("_item").alias(item_column)).agg(
        F.max("_w._agree").cast("long").alias("agreeing"), F.min("_w._from").cast("long").alias("place")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id overlaps with no item; rows without an id stay."""
    found = overlaps(docs, benchmark, id_column, text_column).select(F.col(f"`{id_column}`").alias("__id")).distinct()
    return docs.join(found, F.col(f"`{id_column}`") == F.col("__id"), "left_anti")
