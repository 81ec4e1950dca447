"""Ordered scans that never hold a whole recording in one task.

Nearly every operator of this library reads the rows of one recording in order.
A plain window partitioned by recording would put a hot recording into a single
task, so the scans here work in two levels:

1. rows are cut into *slices* of bounded size (``order div rows``); a window runs
   per (recording, slice);
2. one pre-aggregated *edge* row per slice carries what crosses a slice border
   (last row, first row, totals); a window over the edges of a recording adds the
   missing part, and the edges are joined back on (recording, slice).

The order column is an integer, unique inside its keys (a list position, or a
distinct millisecond), which bounds every slice by ``rows``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 65_536
SLICE_MS = 3_600_000
_SLICE = "_slice"


def _div(order: str | Column, rows: int) -> Column:
    """Whole-number division, rounded down, without a detour over doubles."""
    order = F.col(order) if isinstance(order, str) else order
    return F.call_function("div", order - F.pmod(order, F.lit(rows)), F.lit(rows)).cast("long")


def sliced(df: DataFrame, order: str, rows: int) -> DataFrame:
    """Name the slices ahead of several scans in one order: they keep the column, and with
    it the partitioning, so the rows are shuffled once."""
    return df if _SLICE in df.columns else df.withColumn(_SLICE, _div(order, rows))


@dataclass(frozen=True)
class Carry:
    """One value a scan adds to every row; see the constructors below."""

    kind: str
    value: Column


def previous(value: Column) -> Carry:
    """Value of the row before."""
    return Carry("previous", value)


def following(value: Column) -> Carry:
    """Value of the row after."""
    return Carry("following", value)


def running(value: Column) -> Carry:
    """Sum up to and including this row."""
    return Carry("running", value)


def latest(value: Column) -> Carry:
    """Last non-null value at or before this row."""
    return Carry("latest", value)


def soonest(value: Column) -> Carry:
    """First non-null value at or after this row."""
    return Carry("soonest", value)


def final(value: Column) -> Carry:
    """Value of the last row."""
    return Carry("final", value)


def overall_max(value: Column) -> Carry:
    return Carry("max", value)


def overall_min(value: Column) -> Carry:
    return Carry("min", value)


def overall_sum(value: Column) -> Carry:
    return Carry("sum", value)


def _partials(carry: Carry, name: str, order: Column) -> list[Column]:
    v = carry.value
    match carry.kind:
        case "previous" | "final":
            return [F.max_by(v, order).alias(name)]
        case "following":
            return [F.min_by(v, order).alias(name)]
        case "running" | "sum":
            return [F.sum(v).alias(name)]
        case "latest":
            return [F.max_by(v, F.when(v.isNotNull(), order)).alias(name)]
        case "soonest":
            return [F.min_by(v, F.when(v.isNotNull(), order)).alias(name)]
        case "min":
            return [F.min(v).alias(name)]
        case _:
            return [F.max(v).alias(name)]


def _across(carry: Carry, name: str, keys: Sequence[str]) -> Column:
    over = Window.partitionBy(*keys).orderBy(_SLICE)
    back = Window.partitionBy(*keys).orderBy(F.desc(_SLICE))
    past = Window.unboundedPreceding
    match carry.kind:
        case "previous":
            return F.lag(name).over(over)
        case "following":
            return F.lead(name).over(over)
        case "running":
            return F.sum(name).over(over.rowsBetween(past, -1))
        case "latest":
            return F.last(name, ignorenulls=True).over(over.rowsBetween(past, -1))
        case "soonest":
            return F.last(name, ignorenulls=True).over(back.rowsBetween(past, -1))
        case "final":
            return F.last(name).over(over.rowsBetween(past, Window.unboundedFollowing))
        case "sum":
            return F.sum(name).over(Window.partitionBy(*keys))
        case "min":
            return F.min(name).over(Window.partitionBy(*keys))
        case _:
            return F.max(name).over(Window.partitionBy(*keys))


def _local(carry: Carry, name: str, cell: Sequence[str], order: Column) -> Column:
    v, edge = carry.value, F.col(name)
    over = Window.partitionBy(*cell).orderBy(order)
    back = Window.partitionBy(*cell).orderBy(order.desc())
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    match carry.kind:
        case "previous":
            return F.when(F.row_number().over(over) == 1, edge).otherwise(F.lag(v).over(over))
        case "following":
            return F.when(F.lead(order).over(over).isNull(), edge).otherwise(
                F.lead(v).over(over)
            )
        case "running":
            return F.coalesce(F.sum(v).over(so_far), F.lit(0)) + F.coalesce(edge, F.lit(0))
        case "latest":
            return F.coalesce(F.last(v, ignorenulls=True).over(so_far), edge)
        case "soonest":
            down = back.rowsBetween(Window.unboundedPreceding, 0)
            return F.coalesce(F.last(v, ignorenulls=True).over(down), edge)
        case _:
            return edge


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carries: Mapping[str, Carry],
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add one column per carry, in ``order`` inside ``keys``."""
    cell = [*keys, _SLICE]
    pos = F.col(order)
    names = {out: f"_edge_{i}" for i, out in enumerate(carries)}
    cut = sliced(df, order, rows)
    edges = cut.groupBy(*cell).agg(
        *[p for out, c in carries.items() for p in _partials(c, names[out], pos)]
    )
    edges = edges.select(
        *cell, *[_across(c, names[out], keys).alias(names[out]) for out, c in carries.items()]
    )
    return cut.join(edges, cell).select(
        *df.columns,
        *[_local(c, names[out], cell, pos).alias(out) for out, c in carries.items()],
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fields: Sequence[str],
    breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    out: str = "island",
    rows: int = SLICE_ROWS,
    carries: Mapping[str, Carry] | None = None,
) -> DataFrame:
    """Number the runs of rows, from 0; ``breaks(before, here)`` opens a new run.

    The break test runs twice: between neighbours of a slice, and between the last
    row of a slice and the first of the next, so one edge pass is enough. ``carries``
    are added in the same pass.
    """
    carries = carries or {}
    names = {c: f"_edge_{i}" for i, c in enumerate(carries)}
    cell = [*keys, _SLICE]
    pos = F.col(order)
    inside = Window.partitionBy(*cell).orderBy(pos)
    across = Window.partitionBy(*keys).orderBy(_SLICE)

    def opened(before: Callable[[str], Column], here: Callable[[str], Column]) -> Column:
        return F.when(breaks(before, here), 1).otherwise(0)

    cut = sliced(df, order, rows)
    # 0 for the first row of a slice: whether it opens a run is known on the edges
    flagged = cut.withColumn(
        "_opens",
        F.when(F.row_number().over(inside) == 1, 0).otherwise(
            opened(lambda c: F.lag(c).over(inside), F.col)
        ),
    )
    edges = flagged.groupBy(*cell).agg(
        F.sum("_opens").alias("_inner"),
        *[F.min_by(c, order).alias(f"_first_{c}") for c in fields],
        *[F.max_by(c, order).alias(f"_last_{c}") for c in fields],
        *[p for c, carry in carries.items() for p in _partials(carry, names[c], pos)],
    )
    edges = edges.withColumn(
        "_border",
        F.when(F.row_number().over(across) == 1, 0).otherwise(
            opened(lambda c: F.lag(f"_last_{c}").over(across), lambda c: F.col(f"_first_{c}"))
        ),
    )
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *cell,
        (
            F.coalesce(F.sum(F.col("_inner") + F.col("_border")).over(before), F.lit(0))
            + F.col("_border")
        ).alias("_base"),
        *[_across(carry, names[c], keys).alias(names[c]) for c, carry in carries.items()],
    )
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return flagged.join(edges, cell).select(
        *df.columns,
        *[_local(carry, names[c], cell, pos).alias(c) for c, carry in carries.items()],
        (F.sum("_opens").over(so_far) + F.col("_base")).alias(out),
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    seq: str,
    out: str = "pos",
    rows: int = SLICE_ROWS,
    span_ms: int = SLICE_MS,
) -> DataFrame:
    """Rank from 0 by (time, seq) inside ``keys``, for tables not listed in time order.

    ``seq`` is unique inside its keys. Rows are counted per (time, block of seq), the
    counts are added up over those cells, and ranks are taken inside a cell only, so a
    millisecond that holds a third of the table is still cut into blocks of ``rows``.
    """
    numbered = df.withColumn("_block", _div(seq, rows))
    cell = [*keys, time, "_block"]
    counts = numbered.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn(_SLICE, _div(time, span_ms))
    over = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        counts.groupBy(*keys, _SLICE)
        .agg(F.sum("_n").alias("_span"))
        .select(*keys, _SLICE, F.coalesce(F.sum("_span").over(over), F.lit(0)).alias("_base"))
    )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(time, "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.join(spans, [*keys, _SLICE]).select(
        *cell, (F.coalesce(F.sum("_n").over(inside), F.lit(0)) + F.col("_base")).alias("_base")
    )
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(seq)) - 1
    return numbered.join(offsets, cell).select(
        *df.columns, (rank + F.col("_base")).cast("long").alias(out)
    )


def joined_text(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    text: Column,
    separator: str,
    out: str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """One text per key: parts in order, put together per slice first."""
    pieces = (
        df.withColumn(_SLICE, _div(order, rows))
        .withColumn("_part", text)
        .groupBy(*keys, _SLICE)
        .agg(F.expr(f"listagg(_part, '{_quoted(separator)}') WITHIN GROUP (ORDER BY {order})").alias("_part"))
    )
    return pieces.groupBy(*keys).agg(
        F.expr(f"listagg(_part, '{_quoted(separator)}') WITHIN GROUP (ORDER BY {_SLICE})").alias(out)
    )


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")


#: Interval length classes, as powers of two of a millisecond: 4 s to 8.9 years, and one for all that is longer.
_CLASSES = (12, 16, 20, 24, 28, 32, 38, 62)


def _cells(level: int, value: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.shiftright(value, level).alias("cell"))


def interval_cells(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Cover ``[start, end]`` by at most two cells of the class it fits in."""
    cover = F.lit(None)
    for level in reversed(_CLASSES):
        both = F.array_distinct(F.array(_cells(level, start), _cells(level, end)))
        cover = both if level == _CLASSES[-1] else F.when(
            end - start <= F.lit(1 << level), both
        ).otherwise(cover)
    return df.withColumn("_cell", F.explode(cover))


def point_cells(df: DataFrame, at: Column) -> DataFrame:
    """The cell of ``at`` in every class: an interval meets a point in one cell only."""
    return df.withColumn("_cell", F.explode(F.array(*[_cells(n, at) for n in _CLASSES])))
