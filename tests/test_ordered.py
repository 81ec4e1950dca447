"""The two-level scans and greedy folds against plain Python, with tiny slices."""

import random

import pytest
from pyspark.sql import functions as F

from talkledger.operators import ordered as o
from talkledger.operators.folds import Rule, greedy_groups


def _rows(seed, keys=4, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(keys):
        for i in range(rnd.randint(1, n)):
            out.append((k, i, rnd.choice("AB"), rnd.randint(0, 9), rnd.choice([None, 1, 2])))
    return out


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_scan_matches_plain_lists(spark, rows):
    data = _rows(rows)
    df = spark.createDataFrame(data, "k long, i long, s string, v long, m long")
    got = {
        (r.k, r.i): r
        for r in o.scan(
            df, ["k"], "i",
            {
                "p": o.previous(F.col("s")), "f": o.following(F.col("s")),
                "t": o.running(F.col("v")), "l": o.latest(F.col("m")),
                "n": o.soonest(F.col("m")), "mx": o.overall_max(F.col("v")),
                "sm": o.overall_sum(F.col("v")),
            },
            rows,
        ).collect()
    }
    assert len(got) == len(data)
    for k in {d[0] for d in data}:
        mine = [d for d in data if d[0] == k]
        for i, d in enumerate(mine):
            r = got[(k, d[1])]
            assert r.p == (mine[i - 1][2] if i else None)
            assert r.f == (mine[i + 1][2] if i + 1 < len(mine) else None)
            assert r.t == sum(x[3] for x in mine[: i + 1])
            assert r.l == next((x[4] for x in reversed(mine[: i + 1]) if x[4]), None)
            assert r.n == next((x[4] for x in mine[i:] if x[4]), None)
            assert (r.mx, r.sm) == (max(x[3] for x in mine), sum(x[3] for x in mine))


@pytest.mark.parametrize("rows", [1, 4, 1000])
def test_islands(spark, rows):
    data = _rows(rows + 10)
    df = spark.createDataFrame(data, "k long, i long, s string, v long, m long")
    got = {
        (r.k, r.i): r.island
        for r in o.islands(df, ["k"], "i", ["s"], lambda b, h: b("s") != h("s"), rows=rows).collect()
    }
    for k in {d[0] for d in data}:
        number, last = -1, None
        for d in (x for x in data if x[0] == k):
            number += d[2] != last
            last = d[2]
            assert got[(k, d[1])] == number


@pytest.mark.parametrize("rows,span", [(2, 3), (1000, 1000)])
def test_positions_split_a_hot_millisecond(spark, rows, span):
    rnd = random.Random(5)
    data = [(k, rnd.choice([7, 7, 7, rnd.randint(0, 30)]), s) for k in range(3) for s in range(50)]
    df = spark.createDataFrame(data, "k long, t long, s long")
    got = {(r.k, r.s): r.pos for r in o.positions(df, ["k"], "t", "s", rows=rows, span_ms=span).collect()}
    for k in range(3):
        mine = sorted((t, s) for kk, t, s in data if kk == k)
        assert [got[(k, s)] for _, s in mine] == list(range(50))


def _packed(values, limit, max_rows):
    groups, count, size = -1, 0, 0
    out = []
    for v in values:
        if groups < 0 or size + v > limit or count >= max_rows:
            groups, count, size = groups + 1, 0, 0
        count, size = count + 1, size + v
        out.append(groups)
    return out


def _anchored(values, window, forced):
    groups, anchor, out = -1, None, []
    for v, f in zip(values, forced, strict=True):
        if anchor is None or f or v - anchor >= window:
            groups, anchor = groups + 1, v
        out.append(groups)
    return out


@pytest.mark.parametrize("rows", [1, 2, 5, 17, 1000])
@pytest.mark.parametrize("kind", ["chars", "batch", "sorted", "unsorted", "nearly"])
def test_greedy_groups(spark, rows, kind):
    rnd = random.Random(1000 * rows + ["chars", "batch", "sorted", "unsorted", "nearly"].index(kind))
    data, want = [], {}
    for k in range(200):
        n = rnd.randint(1, 80)
        if kind in ("chars", "batch"):
            vals = [rnd.choice([0, 1, 3, 8, 25, 60]) for _ in range(n)]
            forced = [False] * n
            expect = _packed(vals, 40, 4 if kind == "batch" else 10**9)
        else:
            vals = [rnd.randint(0, 400) for _ in range(n)]
            if kind != "unsorted":
                vals.sort()
            if kind == "nearly":
                vals = [max(0, x + rnd.randint(-60, 60)) for x in vals]
            forced = [kind == "unsorted" and rnd.random() < 0.1 for _ in range(n)]
            expect = _anchored(vals, 50, forced)
        for i, v in enumerate(vals):
            data.append((f"k{k}", i, v, forced[i]))
            want[(f"k{k}", i)] = expect[i]
    df = spark.createDataFrame(data, "k string, i long, v long, f boolean")
    rule = {
        "chars": Rule(40), "batch": Rule(40, max_rows=4),
        "sorted": Rule(50, anchored=True, rising=True), "unsorted": Rule(50, anchored=True), "nearly": Rule(50, anchored=True),
    }[kind]
    got = {(r.k, r.i): r.group_idx for r in greedy_groups(df, ["k"], "i", F.col("v"), rule, F.col("f"), rows).collect()}
    assert got == want


def test_interval_cells_meet_points_once(spark):
    rnd = random.Random(1)
    spans = [(i, s, s + rnd.choice([0, 10, 5000, 900_000, 10**9, 10**11])) for i in range(60)
             for s in [rnd.randint(-10**6, 10**10)]]
    points = [(i, rnd.choice([rnd.randint(-10**6, 10**10), rnd.choice(spans)[1], rnd.choice(spans)[2]]))
              for i in range(60)]
    a = o.interval_cells(spark.createDataFrame(spans, "i long, s long, e long"), F.col("s"), F.col("e"))
    b = o.point_cells(spark.createDataFrame(points, "p long, t long"), F.col("t"))
    got = sorted((r.i, r.p) for r in a.join(b, "_cell").where("t between s and e").collect())
    assert got == sorted((i, p) for i, s, e in spans for p, t in points if s <= t <= e)
