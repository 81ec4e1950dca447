"""Greedy groups: where a group ends depends on where it began.

No lag or running sum can say where such a group starts, so a slice is read by a
small numpy walk. Slices of one key run in parallel all the same:

1. *summary*: for every place where the first cut of a slice may fall, the state at
   the end of the slice and the number of groups opened (few places, because the first
   cut falls within one window, limit or row count of the slice start);
2. *chain*: one pass over the summaries of a key, in order, gives the state each slice
   is entered with;
3. *apply*: each slice is walked once from its entry state.

Keys with a single slice (all but very long recordings) skip steps 1 and 2.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger.operators.ordered import SLICE_ROWS, _div

_NO_ROWS = 1 << 60


@dataclass(frozen=True)
class Rule:
    """How a group ends.

    ``anchored``: at the first row whose value is ``limit`` or more past the value of
    the group's first row, or whose ``force`` is set.
    otherwise: when the summed values would pass ``limit``, or the group has ``max_rows``.
    ``rising``: the caller vouches that the values never fall along the whole key, so that an
    anchor from an earlier slice is not above a slice's first value.
    """

    limit: int
    anchored: bool = False
    max_rows: int = _NO_ROWS
    rising: bool = False


class _Slice:
    def __init__(self, rule: Rule, value: np.ndarray, force: np.ndarray) -> None:
        self.rule, self.n, self.value = rule, len(value), value.astype(np.int64)
        self.forced = np.flatnonzero(force)
        if rule.anchored:
            self.mark = self.value
            self.sorted = bool(np.all(self.value[1:] >= self.value[:-1]))
        else:
            self.sums = np.concatenate(([0], np.cumsum(self.value)))
            self.mark = self.sums[1:]

    def next_start(self, i: int) -> int:
        """First row after ``i`` that opens a group, if ``i`` opens one."""
        if not self.rule.anchored:
            j = int(np.searchsorted(self.sums, self.sums[i] + self.rule.limit, "right")) - 1
            return min(max(i + 1, j), i + self.rule.max_rows, self.n)
        k = int(np.searchsorted(self.forced, i, "right"))
        stop = int(self.forced[k]) if k < len(self.forced) else self.n
        goal = self.value[i] + self.rule.limit
        if self.sorted:
            return min(max(i + 1, int(np.searchsorted(self.value, goal, "left"))), stop)
        ahead = np.flatnonzero(self.value[i + 1 : stop] >= goal)
        return i + 1 + int(ahead[0]) if len(ahead) else stop

    def exit_state(self, i: int) -> tuple[int, int]:
        """State at the end of the slice when ``i`` opened the last group."""
        if self.rule.anchored:
            return int(self.value[i]), 0
        return int(self.sums[-1] - self.sums[i]), self.n - i

    def first_cut(self, state: tuple[int, int]) -> int:
        return _first_cut(self.rule, state, self._record_marks(), self.n)

    def _record_marks(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can be the first to reach a mark, and the mark they reach."""
        marks = self.mark
        if self.rule.anchored and len(self.forced):
            marks = marks[: self.forced[0] + 1].copy()
            marks[-1] = np.iinfo(np.int64).max
        high = np.maximum.accumulate(marks)
        rows = np.flatnonzero(np.concatenate(([True], high[1:] > high[:-1])))
        return rows, high[rows]

    def summary(self) -> dict[str, list[int]]:
        rows, marks = self._record_marks()
        if not self.rule.anchored:
            # an open group needs limit - chars + 1 more, at most limit + 1
            keep = int(np.searchsorted(marks, self.rule.limit + 1, "left")) + 1
            rows, marks = rows[:keep], marks[:keep]
            if self.rule.max_rows < _NO_ROWS:
                rows = np.arange(min(self.n, self.rule.max_rows))
                marks = self.mark[rows]
        elif self.rule.rising:
            keep = int(np.searchsorted(marks, self.value[0] + self.rule.limit, "left")) + 1
            rows, marks = rows[:keep], marks[:keep]
        ends: dict[int, tuple[int, int, int]] = {}
        for row in [0, *rows.tolist()]:
            path = []
            i = row
            while i < self.n and i not in ends:
                path.append(i)
                i = self.next_start(i)
            opened = ends[i][2] if i < self.n else 0
            state = ends[i][:2] if i < self.n else self.exit_state(path[-1]) if path else None
            for back in reversed(path):
                opened += 1
                ends[back] = (*state, opened)
        outcome = [ends[int(r)] for r in rows]
        if self.rule.max_rows == _NO_ROWS:
            # same outcome as the next mark: one entry is enough
            kept = [k for k in range(len(rows)) if k + 1 == len(rows) or outcome[k] != outcome[k + 1]]
        else:
            kept = list(range(len(rows)))
        return {
            "marks": [int(marks[k]) for k in kept],
            "cuts": [int(rows[k]) for k in kept],
            "exits": [outcome[k][0] for k in kept],
            "exit_rows": [outcome[k][1] for k in kept],
            "opened": [outcome[k][2] for k in kept],
            "fresh": list(ends[0]),
            "through": [0 if self.rule.anchored else int(self.sums[-1]), self.n],
        }

    def starts(self, state: tuple[int, int] | None) -> list[int]:
        i = 0 if state is None else self.first_cut(state)
        found = []
        while i < self.n:
            found.append(i)
            i = self.next_start(i)
        return found


def _first_cut(rule: Rule, state: tuple[int, int], records, n: int) -> int:
    rows, marks = records
    need = state[0] + rule.limit if rule.anchored else rule.limit - state[0] + 1
    k = int(np.searchsorted(marks, need, "left"))
    by_mark = int(rows[k]) if k < len(rows) else n
    return min(by_mark, max(0, rule.max_rows - state[1]), n)


_SUMMARY = (
    "marks array<bigint>, cuts array<bigint>, exits array<bigint>, exit_rows array<bigint>, "
    "opened array<bigint>, fresh array<bigint>, through array<bigint>"
)


def _chain_slice(rule: Rule, row, state: tuple[int, int] | None) -> tuple[tuple[int, int], int]:
    """State after a slice and the groups it opened, from its summary alone."""
    if state is None:
        x, r, opened = row.fresh
        return (int(x), int(r)), int(opened)
    need = state[0] + rule.limit if rule.anchored else rule.limit - state[0] + 1
    k = bisect_left(row.marks, need)
    if rule.max_rows < _NO_ROWS:
        k = min(k, max(0, rule.max_rows - state[1]))
    if k < len(row.marks):
        return (int(row.exits[k]), int(row.exit_rows[k])), int(row.opened[k])
    total, n = row.through
    return (state[0] + int(total), state[1] + int(n)), 0


def _whole_cells(
    batches: Iterator[pd.DataFrame], columns: Sequence[str]
) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of a sorted partition, cut so that no cell is split; with the cell starts."""
    rest = None
    for pdf in batches:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        new = np.zeros(len(pdf), dtype=bool)
        new[0] = True
        for c in columns:
            values = pdf[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        rest = pdf.iloc[starts[-1] :]
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]], starts[:-1]
    if rest is not None:
        yield rest, np.zeros(1, dtype=np.int64)


def greedy_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    rule: Rule,
    force: Column | None = None,
    rows: int = SLICE_ROWS,
    out: str = "group_idx",
) -> DataFrame:
    """(keys, order, group number from 0) for every row of ``df``."""
    cell = [*keys, "_slice"]
    narrow = df.select(
        *keys,
        order,
        value.cast("long").alias("_value"),
        (F.lit(False) if force is None else F.coalesce(force, F.lit(False))).alias("_force"),
        _div(order, rows).alias("_slice"),
    )
    key_ddl = ", ".join(f"`{k}` {t}" for k, t in df.dtypes if k in keys)
    key_cols = [k for k, _ in df.dtypes if k in keys]

    def slices(pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[int, int, _Slice]]:
        value, force = pdf["_value"].to_numpy(), pdf["_force"].to_numpy(dtype=bool)
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            yield a, b, _Slice(rule, value[a:b], force[a:b])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_cells(batches, [*key_cols, "_slice"]):
            head = pdf.iloc[starts][[*key_cols, "_slice"]].reset_index(drop=True)
            found = pd.DataFrame([part.summary() for _, _, part in slices(pdf, starts)])
            yield pd.concat([head, found], axis=1)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, base, last = None, 0, None
        for pdf in batches:
            rows_out = []
            for row in pdf.rename(columns={"_slice": "slice_no"}).itertuples(index=False):
                if last is not None and row.slice_no <= last:
                    raise RuntimeError("slices of one key must arrive in order")
                last = row.slice_no
                if state is not None:
                    rows_out.append(
                        {**{k: getattr(row, k) for k in key_cols}, "_slice": row.slice_no,
                         "_x": state[0], "_r": state[1], "_base": base}
                    )
                state, opened = _chain_slice(rule, row, state)
                base += opened
            if rows_out:
                yield pd.DataFrame(rows_out)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _whole_cells(batches, [*key_cols, "_slice"]):
            numbers = np.empty(len(pdf), dtype=np.int64)
            entered = pdf["_x"].to_numpy(dtype=float, na_value=np.nan) if "_x" in pdf else None
            for a, b, part in slices(pdf, starts):
                state, base = None, 0
                if entered is not None and not np.isnan(entered[a]):
                    state = int(pdf["_x"].iloc[a]), int(pdf["_r"].iloc[a])
                    base = int(pdf["_base"].iloc[a])
                opens = np.zeros(part.n, dtype=np.int64)
                opens[part.starts(state)] = 1
                numbers[a:b] = np.cumsum(opens) + base - 1
            yield pdf[[*key_cols, order]].assign(**{out: numbers})

    def in_cells(rows_df: DataFrame) -> DataFrame:
        return rows_df.repartition(*cell).sortWithinPartitions(*cell, order)

    order_type = dict(df.dtypes)[order]
    result = f"{key_ddl}, `{order}` {order_type}, `{out}` bigint"
    long_keys = narrow.where(F.col("_slice") != 0).select(*keys).distinct()
    summaries = in_cells(narrow.join(long_keys, list(keys), "left_semi")).mapInPandas(
        summarise, f"{key_ddl}, `_slice` bigint, {_SUMMARY}"
    )
    entries = (
        summaries.repartition(*keys)
        .sortWithinPartitions(*cell)
        .groupBy(*keys)
        .applyInPandas(chain, f"{key_ddl}, `_slice` bigint, _x bigint, _r bigint, _base bigint")
    )
    return in_cells(narrow.join(entries, cell, "left")).mapInPandas(apply, result)
