import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as E

POINT = "s int, idx int, time double, mark string"


def tier(rng, s, n, length=20.0):
    times = sorted(round(rng.uniform(0, length), 2) for _ in range(n))
    return [(s, i, t, rng.choice("abc")) for i, t in enumerate(times)]


def test_iou(spark):
    rng = random.Random(1)
    p = [r for s in range(4) for r in tier(rng, s, 15)]
    t = [r for s in range(4) for r in tier(rng, s, 12)]
    total, common = {}, {}
    cells = lambda rows, s: [(a[3], a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] == s]
    for s in range(4):
        for m, a, b in cells(p, s) + cells(t, s):
            total[m] = total.get(m, 0) + b - a
        for m, a, b in cells(p, s):
            for m2, c, d in cells(t, s):
                if m == m2:
                    common[m] = common.get(m, 0) + max(0, min(b, d) - max(a, c))
    for block in (4, 10**6):
        left, right = (E.tier_intervals(spark.createDataFrame(x, POINT), ["s"], "idx", "time", "mark", block) for x in (p, t))
        got = {r.mark: r.iou for r in E.interval_iou(left, right, ["s"], 1.5).collect()}
        assert got == pytest.approx({m: common[m] / (total[m] - common[m]) for m in total}, abs=1e-6)


def edits_loop(p, t, low, high):
    n = min(len(p), len(t))
    table = {(i, 0): i for i in range(n + 1)} | {(0, j): 2 * j for j in range(n + 1)}
    for i in range(1, n + 1):
        for j in range(1, n + 1):
            fresh = j == 1 or t[j - 1][1] != t[j - 2][1]
            far = abs(p[i - 1][0] - t[j - 1][0])
            table[i, j] = min(
                table[i, j - 1] + (2 if fresh else 1), table[i - 1, j] + 1,
                table[i - 1, j - 1] + (low <= far < high) + (p[i - 1][1] != t[j - 1][1]),
            )
    return table[n, n]


def test_edits_and_displacement(spark):
    rng = random.Random(2)
    p, t = [], []
    for s in range(12):
        a = tier(rng, s, rng.randint(3, 10))
        b = [(s, i, r[2] + rng.choice([0, 0.5, 1.5]), r[3]) for i, r in enumerate(a)] if s % 3 else tier(rng, s, rng.randint(3, 10))
        p, t = p + a, t + b
    left, right = spark.createDataFrame(p, POINT), spark.createDataFrame(t, POINT)
    own = lambda rows, s: [(r[2], r[3]) for r in rows if r[0] == s]
    got = {r.s: r.edits for r in E.label_edits(left, right, ["s"], 0.4, 1.0).collect()}
    assert got == {s: edits_loop(own(p, s), own(t, s), 0.4, 1.0) for s in range(12)}
    moved = {r.s: r for r in E.boundary_displacement(left, right, ["s"]).collect()}
    for s in range(12):
        a, b = own(p, s), own(t, s)
        if len(a) == len(b):
            assert moved[s].rejected == any(x[1] != y[1] for x, y in zip(a, b))
            assert moved[s].distance == pytest.approx(sum(abs(x[0] - y[0]) for x, y in zip(a, b)))
        else:
            assert moved[s].points + moved[s].errors == len(b)
    r = E.displacement_totals(E.boundary_displacement(left, right, ["s"])).collect()[0]
    fine = [m for m in moved.values() if not m.rejected]
    span, far = sum(m.span for m in fine), round(sum(m.distance for m in fine), 6)
    kept = 1 - sum(m.errors for m in moved.values()) / sum(m.points for m in fine)
    assert r.ratio == pytest.approx(far / span, abs=1e-6)
    assert r.weighted_ratio == pytest.approx(far / span / kept + (12 - len(fine)) / 12 * 0.2, abs=1e-5)


def test_lcs_pairs():
    a, b = np.array(list("abcbdab")), np.array(list("bdcaba"))
    pairs = E._lcs_pairs(a, b)
    assert len(pairs) == 4 and all(a[i] == b[j] for i, j in pairs)


@pytest.mark.parametrize("block", [5, 10**6])
def test_trimmed_mean(spark, block):
    rng = random.Random(3)
    rows = [(k, round(rng.choice([1, 10]) * rng.random(), 2)) for k in (1, 1, 2, 3) for _ in range(15)] + [(9, 4.0), (9, 4.0)]
    got = {r.k: r.trimmed_mean for r in E.trimmed_mean(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", rows_per_block=block).collect()}
    for k in (1, 2, 3, 9):
        v = [x for kk, x in rows if kk == k]
        m = statistics.median(v)
        mad = statistics.median(abs(x - m) for x in v)
        kept = [x for x in v if mad and abs(x - m) / (mad * 1.4826) <= 1.5]
        assert got[k] == pytest.approx(statistics.mean(kept) if kept else m)
    s = E.median_spread(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 6.0)], "k int, v double"), ["k"], "v", 4.0, block).collect()[0]
    assert (s.median, s.spread) == (2.0, pytest.approx(5 / 3)) and s.strength == pytest.approx(1 - 5 / 12)


def test_majority_and_groups(spark):
    rows = [(1, 0, ["a"]), (1, 1, ["b", "c"]), (1, 2, ["a"]), (1, 3, ["b", "c"]), (2, 0, ["x"]), (3, 0, ["x"]), (3, 1, ["y"])]
    got = {r.g: (r.q, r.votes) for r in E.majority_sequence(spark.createDataFrame(rows, "g int, i int, q array<string>"), ["g"], "i", "q").collect()}
    assert got == {1: (["b", "c"], 2), 2: (["x"], 1)}
    df = spark.createDataFrame([(["SP", "k", "a", "SP", "n"], [0.1, 0.2, 0.3, 0.4, 0.5], [1, 2, 2])], "l array<string>, d array<double>, n array<int>")
    lead = E.group_durations(df, "l", "d", "n", ["SP"], "lead").collect()[0].words
    assert [(round(w.duration, 6), w.voiced) for w in lead] == [(0.1, 0), (0.5, 1), (0.9, 0)]
    every = E.group_durations(df, "l", "d", "n", ["SP"]).collect()[0].words
    assert [w.voiced for w in every] == [0, 1, 1]
