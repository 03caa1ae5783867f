import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import snap as S
from tidemark.scan import with_blocks
from tidemark.shortest import cheapest_states

KIND = "s int, i int, onset double, offset double, lyric string"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def result(df):
    return [(r.s, r.i, round(r.onset, 9), round(r.offset, 9)) for r in sorted(df.collect(), key=lambda r: (r.s, r.onset, r.i))]


def melody(seed, n=40, series=3):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        t = 0.0
        for i in range(n):
            t = round(t + rng.choice([0, 0, 0, 0.03, 0.2, 0.9]), 4)
            d = round(rng.uniform(0.02, 0.7), 4)
            rows.append((s, i, t, round(t + d, 4), rng.choice(["-", "la", "di"])))
            t = round(t + d, 4)
    return rows


def test_simple_by_hand(spark):
    rows = [(1, 0, 0.03125, 0.09375, "half"), (2, 0, 0.02, 0.1, "a"), (2, 1, 0.2, 0.31, "b"), (3, 0, 0.01, 0.02, "x"), (3, 1, 0.02, 0.4, "y")]
    got = result(S.snap_timeline(frame(spark, rows), ["s"], ["i"], 120.0, 60, None))
    assert got == [(1, 0, 0.0, 0.125), (2, 0, 0.0, 0.125), (2, 1, 0.1875, 0.3125), (3, 0, 0.0, 0.0625), (3, 1, 0.0625, 0.375)]


def simple_loop(rows, tempo, step):
    tick = lambda t: round(round(t * tempo * 8) / step) * step
    starts = []
    for r in rows:
        q = tick(r[2])
        starts.append(q if not starts or q > starts[-1] else starts[-1] + step)
    out = []
    for k, r in enumerate(rows):
        last = k == len(rows) - 1
        e = starts[k + 1] if not last and abs(r[3] - rows[k + 1][2]) < 1e-3 else tick(r[3])
        e = max(e, starts[k] + step) if e <= starts[k] else e
        out.append((starts[k], e if last else min(e, starts[k + 1])))
    return out


@pytest.mark.parametrize("block", [7, 10**6])
def test_simple(spark, block):
    rows = melody(1)
    got = S.snap_simple(frame(spark, rows), ["s"], ["i"], 110.0, 60, block)
    found = {(r.s, r.i): (r.onset * 880, r.offset * 880) for r in got.collect()}
    for s in range(3):
        own = [r for r in rows if r[0] == s]
        for r, want in zip(own, simple_loop(own, 110.0, 60)):
            assert found[s, r[1]] == pytest.approx(want)


@pytest.mark.parametrize("block", [5, 10**6])
@pytest.mark.parametrize("cost_first", [False, True])
def test_cheapest_states(spark, block, cost_first):
    rng = random.Random(4)
    rows, best = [], {}
    for s in range(4):
        costs = [[rng.randint(0, 9) / 1.0 for _ in range(3)] for _ in range(23 if s == 0 else 7)]
        rows += [(s, i + 1, c) for i, c in enumerate(costs)]
        best[s] = costs
    apart = np.array([[0, 1, 4], [1, 0, 1], [4, 1, 0]], dtype=float)
    df = with_blocks(spark.createDataFrame(rows, "s int, n bigint, c array<double>"), ["s"], "n", block)
    out = cheapest_states(df, ["s"], "n", "c", lambda pdf, i: apart, cost_first).collect()
    for s, costs in best.items():
        path = [r.state for r in sorted((r for r in out if r.s == s), key=lambda r: r.n)]
        total = sum(c[k] for c, k in zip(costs, path)) + sum(apart[a, b] for a, b in zip(path, path[1:]))
        low = np.array(costs[0])
        for c in costs[1:]:
            low = (low[:, None] + apart).min(axis=0) + c
        assert total == low.min()


def test_blocked_modes_equal_plain(spark):
    df = frame(spark, melody(3, n=60)).cache()
    for mode in ("smart", "bayes", "dp"):
        plain = result(S.snap_timeline(df, ["s"], ["i"], 120.0, 60, mode))
        assert result(S.snap_timeline(df, ["s"], ["i"], 120.0, 60, mode, rows_per_block=25)) == plain, mode


def test_chain_by_enumeration(spark):
    step, tempo = 60, 120.0
    rows = [(1, 0, 0.0, 0.1, "a"), (1, 1, 0.1, 0.45, "b"), (1, 2, 0.8, 0.9, "c"), (1, 3, 0.9, 1.0, "d")]
    on = [round(r[2] * 960) for r in rows]
    off = [round(r[3] * 960) for r in rows]
    raw = [b - a for a, b in zip(on, off)]
    cap = -(-max(raw) // step) * step + 2 * step
    lengths = [m * step for m in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32) if m * step <= cap]
    pen = lambda c: 0.0 if c // step in (1, 2, 4, 8, 16) else 0.08 * step
    best = min(
        itertools.product(lengths, repeat=4),
        key=lambda p: sum(abs(a - c) + pen(c) for a, c in zip(raw, p)) + sum(abs(a - b) * 0.08 for a, b in zip(p, p[1:])),
    )
    at, want = round(on[0] / step) * step, []
    for k, d in enumerate(best):
        want.append((at / 960, (at + d) / 960))
        if k < 3:
            rest = max(0, on[k + 1] - off[k])
            at += d + (0 if rest < step * 0.5 else round(rest / step) * step)
    got = S.snap_timeline(frame(spark, rows), ["s"], ["i"], tempo, step, "SMART").collect()
    assert np.allclose([(r.onset, r.offset) for r in sorted(got, key=lambda r: r.i)], want)


def test_modes_by_hand(spark):
    rows = [(1, 0, 0.02, 0.1, "early"), (1, 1, 0.2, 0.31, "late")]
    dp = result(S.snap_timeline(frame(spark, rows), ["s"], ["i"], 120.0, 60, "dp"))
    assert dp == [(1, 0, 0.0, 0.0625), (1, 1, 0.25, 0.375)]
    bayes = result(S.snap_timeline(frame(spark, rows), ["s"], ["i"], 120.0, 60, "bayes"))
    assert bayes == [(1, 0, 0.0, 0.125), (1, 1, 0.25, 0.375)]
    zero = result(S.snap_timeline(frame(spark, [(1, 0, 0.03125, 0.09375, "z")]), ["s"], ["i"], 120.0, 0, "dp"))
    assert zero == [(1, 0, 0.0, 0.0625)]


def test_phase_centre_and_patterns(spark):
    ticks = [45, 100, 165, 225, 281]
    df = spark.createDataFrame([(1, t, 50, 5, False) for t in ticks] + [(2, 3, 50, 0, False)], "s int, on bigint, len bigint, gap bigint, tie boolean")
    rows = {r.s: r for r in S.phase_centre(df, ["s"], "on", 60).collect()}
    phases = [t % 60 for t in ticks]
    mid = float(np.median(phases))
    assert rows[1].centre == -mid
    assert rows[2].centre == -3.0 and rows[2].weight == pytest.approx(0.03)
    many = df.filter("s = 1").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    r = S.frequent_patterns(many, ["s"], "on", "len", "gap", "tie", 60).collect()
    assert len(r) == 1 and (r[0].n, r[0].length_multiple, r[0].preferred_length, r[0].preferred_gap) == (10, 1, 60, 0)
    assert r[0].strength == pytest.approx(0.65)


@pytest.mark.parametrize("block", [4, 10**6])
def test_repair_overlaps(spark, block):
    rng = random.Random(6)
    rows, want = [], set()
    for s in range(6):
        before = None
        for i in range(30):
            a = 30 * (4 * i + rng.randint(-6, 6))
            b = a + 30 * rng.randint(-1, 6)
            rows.append((s, i, a, b))
            if before is not None:
                a = max(a, before)
            b = b if b > a else a + 60
            want.add((s, i, a, b))
            before = b
    df = spark.createDataFrame(rows, "s int, i bigint, a bigint, b bigint")
    assert {tuple(r) for r in S.repair_overlaps(df, ["s"], "i", "a", "b", 60, block).collect()} == want
