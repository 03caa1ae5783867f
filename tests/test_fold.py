import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as V
from tidemark.operators import islands as I
from tidemark.operators import series as R
from tidemark.operators import snap as N

BLOCKS = (10**6, 8)


def same_at_all_sizes(make, key):
    whole, parts = (sorted((tuple(r) for r in make(size).collect()), key=key) for size in BLOCKS)
    assert parts == whole and whole
    return whole


@pytest.mark.parametrize("kind", ["ramp", "walk", "flat", "noise"])
def test_one_run_of_touching_rows(spark, kind):
    rng, at, rows = random.Random(1), 60.0, []
    for i in range(120):
        at = {"ramp": at + 0.03, "walk": at + rng.choice([-0.04, 0.04, 0.0]), "flat": 60.0, "noise": 60.0 + rng.choice([0, 0.05, 0.1, 0.3])}[kind]
        rows.append((1, i, float(i), i + 1.0, round(at, 3), "-"))
    rows += [(2, 0, 0.0, 1.0, 50.0, "a"), (2, 1, 1.0, 2.0, 50.0, "-")]
    df = spark.createDataFrame(rows, "s int, i int, a double, b double, v double, l string")
    got = same_at_all_sizes(lambda size: I.anchored_runs(df, ["s"], "a", "b", "v", "l", ["i"], rows_per_block=size), str)
    want, base = [], None
    for s, _, a, b, v, _ in rows[:120]:
        if base is None or not abs(base - v) < 0.1:
            want.append([s, a, b, v, "-", 1])
            base = v
        else:
            want[-1][2] = b
            want[-1][-1] += 1
    assert sorted([r for r in got if r[0] == 1], key=str) == sorted(map(tuple, want), key=str)


def test_one_run_of_spikes(spark):
    rng = random.Random(2)
    rows = [(1, 7, i, rng.choice([0, 100, 300, 1200, rng.randint(0, 2000)])) for i in range(200)]
    rows += [(1, 8, i, rng.randint(0, 500)) for i in range(5)] + [(2, 1, 0, 5)]
    df = spark.createDataFrame(rows, "s int, run int, i int, v int")
    got = same_at_all_sizes(lambda size: R.despike(df, ["s", "run"], ["i"], "v", rows_per_block=size), lambda r: r[:3])
    v = [float(r[3]) for r in rows[:200]]
    for i in range(1, 199):
        off = v[i] - (v[i - 1] + v[i + 1]) / 2.0
        if abs(off) > 75.0:
            v[i] = float(round(v[i] - off * 0.7))
    assert [r[-1] for r in got if r[:2] == (1, 7)] == [int(x) for x in v]


def test_one_stretch_of_pushed_intervals(spark):
    rng = random.Random(3)
    for crowded in (1, 4, 30):
        rows = [(1, i, crowded * i // 4 * 10 - rng.choice([0, 10, 200]), 10 * (i // 3) + rng.choice([0, 5, 40])) for i in range(150)]
        df = spark.createDataFrame(rows, "s int, i int, a long, b long")
        got = same_at_all_sizes(lambda size: N.repair_overlaps(df, ["s"], "i", "a", "b", 10, size), lambda r: r[1])
        before, want = None, []
        for s, i, a, b in rows:
            a = a if before is None else max(a, before)
            before = b if b > a else a + 10
            want.append((s, i, a, before))
        assert got == want


@pytest.mark.parametrize("gap", [0.00005, 0.0002, 0.4])
def test_one_stretch_of_clamped_boundaries(spark, gap):
    rng, at, words = random.Random(4), 0.0, []
    for i in range(90):
        words.append((1, i, at, at + gap))
        at += gap
    notes = [(1, j, x, x + gap / 2) for j in range(40) for x in [rng.uniform(0, at)]]
    left = spark.createDataFrame(words, "s int, idx int, start double, end double")
    right = spark.createDataFrame(notes, "s int, idx int, start double, end double")
    got = same_at_all_sizes(lambda size: V.align_boundaries(left, right, ["s"], tol=5 * gap, rows_per_block=size), lambda r: r[1])
    marks, before, want = sorted({x for n in notes for x in n[2:]}), 0.0, []
    for (_, _, _, raw), (_, _, _, following) in zip(words, words[1:]):
        nearest = min(marks, key=lambda m: (abs(m - raw), m))
        wish = nearest if abs(nearest - raw) <= 5 * gap else raw
        low, high = before + V.MIN_GAP, following - V.MIN_GAP
        before = min(max(wish, low), high) if low < high else raw
        want.append(before)
    assert [r.end if hasattr(r, "end") else r[3] for r in got][:-1] == pytest.approx(want, abs=1e-12)
