"""Mixing sources to target token counts by entropy balancing.

A document may be taken 0 to ``most`` times. Among all such plans whose expected words meet the
target of every source, the one closest in relative entropy to taking each document evenly at
random tilts the copies of document i by exp(multiplier of its source * words of i * copies). The
multipliers solve a convex dual, found by Newton steps over the whole table; the expected copies are
then rounded inside bounded groups so that each group keeps its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkledger.llm.common import stored, text_bytes, words

#: Newton steps at most; each halves the bracket at least, so 80 reach double precision.
MOST_STEPS = 80


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(words(t.as_py())) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["_id", "_source", "size"])


def sized(df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """(_id, _source, size) of every row; size is the number of words, 0 for null and empty texts."""
    rows = df.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{source_column}`").cast("string").alias("_source"),
        text_bytes(text_column).alias("_raw"),
    )
    kind = rows.schema["_id"].dataType
    return rows.mapInArrow(
        _counted, T.StructType([T.StructField("_id", kind), T.StructField("_source", T.StringType()), T.StructField("size", T.LongType())])
    )


def shared_targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> list[float]:
    """Targets of sources in order: all sizes dealt by weight, none above ``most`` times its own size.

    What a full source cannot take is dealt to the others by weight, again until none is above.
    """
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[k % len(weights)] for k in open_)
        share = {k: left * weights[k % len(weights)] / weight for k in open_}
        full = [k for k in open_ if share[k] > most * sizes[k]]
        if not full:
            for k in open_:
                targets[k] = share[k]
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in full]
    return targets


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(_source, source_size, target) of the sources by code point, the null source last.

    One row per source passes the driver: source names, not documents, bound it.
    """
    totals = rows.groupBy("_source").agg(F.sum("size").alias("source_size")).collect()
    totals.sort(key=lambda r: (r._source is None, (r._source or "").encode()))
    targets = shared_targets([r.source_size for r in totals], weights, most)
    return rows.sparkSession.createDataFrame(
        [(r._source, r.source_size, t) for r, t in zip(totals, targets, strict=True)],
        "_source string, source_size long, target double",
    )


def _moments(tilt: Column, most: int) -> tuple[Column, Column]:
    """Mean and variance of the copies 0..most, evenly likely before the tilt."""
    # against the largest term, so that no power overflows
    top = F.greatest(F.lit(0.0), tilt * most)
    mass = [F.exp(tilt * k - top) for k in range(most + 1)]
    total = sum(mass[1:], mass[0])
    mean = sum((m * k for k, m in enumerate(mass[1:], 1)), F.lit(0.0)) / total
    square = sum((m * (k * k) for k, m in enumerate(mass[1:], 1)), F.lit(0.0)) / total
    return mean, square - mean * mean


def multipliers(rows: DataFrame, targets: DataFrame, most: int = 3, close: float = 1e-9) -> dict:
    """The dual solution: source -> (scale, multiplier), tilt = multiplier * size / scale.

    Each step is one aggregate over the (source, size) counts of all documents; Newton's step is kept
    inside a bracket that is halved otherwise. Sums are decimals, so their order does not matter and
    reruns agree. A source whose target is all it can give, or nothing, has an infinite multiplier.
    """
    counts = stored(rows.where("size > 0").groupBy("_source", "size").agg(F.count("*").alias("_n")), "sizes")
    spark = rows.sparkSession
    facts = {
        r._source: (r.source_size, r.target, r.source_size / r._docs)
        for r in targets.join(counts.groupBy(F.col("_source").alias("_s")).agg(F.sum("_n").alias("_docs")), F.col("_s").eqNullSafe(F.col("_source"))).collect()
    }
    found, low, high, now = {}, {}, {}, {}
    for s, (size, target, scale) in facts.items():
        if target >= most * size * (1 - 1e-12):
            found[s] = (scale, float("inf"))
        elif target <= 0:
            found[s] = (scale, float("-inf"))
        else:
            low[s], high[s], now[s] = -1e3 * scale, 1e3 * scale, 0.0
    for _ in range(MOST_STEPS):
        if not now:
            break
        at = spark.createDataFrame(
            [(s, m / facts[s][2]) for s, m in now.items()], "_s string, _m double"
        )
        joined = counts.join(F.broadcast(at), F.col("_s").eqNullSafe(F.col("_source")))
        mean, variance = _moments(F.col("_m") * F.col("size"), most)
        exact = lambda c: F.sum(c.cast("decimal(38,9)"))
        sums = joined.groupBy("_source").agg(
            exact(mean * F.col("size") * F.col("_n")).alias("_words"),
            exact(variance * F.col("size") * F.col("size") * F.col("_n")).alias("_slope"),
        ).collect()
        for r in sums:
            s, (size, target, scale) = r._source, facts[r._source]
            miss, slope, m = float(r._words) - target, float(r._slope) / scale, now[s]
            if abs(miss) <= close * max(1.0, target) or high[s] - low[s] < 1e-13:
                found[s] = (scale, float(f"{m:.10g}"))
                del now[s]
                continue
            low[s], high[s] = (low[s], m) if miss > 0 else (m, high[s])
            step = m - miss / slope if slope > 1e-12 else None
            now[s] = step if step is not None and low[s] < step < high[s] else (low[s] + high[s]) / 2
    found.update({s: (facts[s][2], float(f"{m:.10g}")) for s, m in now.items()})
    return found


def _rounded(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies whose words follow the expected words, longest documents first."""
    group = group.sort_values(["size", "_order", "_id"], ascending=[False, True, True], kind="stable", na_position="last")
    carry, copies = 0.0, []
    for size, rate in zip(group["size"].to_numpy(), group["_rate"].to_numpy()):
        if size == 0:
            copies.append(1)
            continue
        n = min(most, max(0, int(np.floor(rate + carry / size + 0.5))))
        carry += (rate - n) * size
        copies.append(n)
    return group.assign(copies=np.array(copies, dtype=np.int64))


def mix(
    df: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, group_rows: int = 1_000,
) -> DataFrame:
    """Per row: id, ``source``, ``size`` (words), ``source_size``, ``target``, ``rate`` (expected copies),
    ``copies`` (0 to ``most``) and ``taken`` = copies * size words.

    Sources in order of code point, null last, weigh ``weights`` in turn. Documents without words
    (null, empty, blank) are kept once: they take no words. A null id is kept; equal ids are rows of
    their own; an empty table gives no rows. Rounding is done in groups of a source with about
    ``group_rows`` rows each, so no source is one task's work; the words of a group differ from their
    expectation by about its shortest document. Reruns give the same copies.
    """
    rows = stored(sized(df, id_column, source_column, text_column), "sized")
    targets = stored(source_targets(rows, weights, most), "targets")
    tilts = multipliers(rows, targets, most)
    spark = df.sparkSession
    at = spark.createDataFrame([(s, m / scale if abs(m) != float("inf") else m) for s, (scale, m) in tilts.items()], "_s string, _tilt double")
    groups = {
        r._source: max(1, -(-r.n // group_rows)) for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect()
    }
    dealt = spark.createDataFrame([(s, n) for s, n in groups.items()], "_g string, _groups long")
    facts = (
        targets.join(at, F.col("_s").eqNullSafe(F.col("_source")), "left")
        .join(dealt, F.col("_g").eqNullSafe(F.col("_source")), "left")
        .select(F.col("_source").alias("_f"), "source_size", "target", "_tilt", "_groups")
    )
    facts = stored(facts, "tilts")
    mean, _ = _moments(F.col("_tilt") * F.col("size"), most)
    rate = (
        F.when((F.col("size") == 0) | F.col("_tilt").isNull(), 1.0)
        .when(F.col("_tilt") == float("inf"), float(most))
        .when(F.col("_tilt") == float("-inf"), 0.0)
        .otherwise(F.round(mean, 9))
    )
    order = F.xxhash64(F.col("_id").cast("string"))
    expected = rows.join(facts, F.col("_f").eqNullSafe(F.col("_source")), "left").select(
        "_id", "_source", "size", "source_size", "target", rate.alias("_rate"), order.alias("_order"),
        F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(1)), F.col("_groups")).alias("_group"),
    )
    result = T.StructType([*expected.schema.fields, T.StructField("copies", T.LongType())])
    rounded = expected.groupBy("_source", "_group").applyInPandas(lambda g: _rounded(g, most), result)
    return rounded.select(
        F.col("_id").alias(id_column), F.col("_source").alias("source"), "size", "source_size", "target",
        F.col("_rate").alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeated(df: DataFrame, mixed: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of ``df``, each as often as ``mixed`` says; rows that share an id share their copies.

    Rows without an id, which no copies can name, stay once.
    """
    copies = mixed.groupBy(F.col(f"`{id_column}`").alias("__id")).agg(F.first("copies").alias("__n")).where("__id is not null")
    joined = df.join(copies, F.col(f"`{id_column}`") == F.col("__id"), "left")
    times = F.coalesce(F.col("__n"), F.lit(1)).cast("int")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array_repeat(F.lit(1), times)).alias("__k")).drop("__k")
