import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import segments as S
from tidemark.plans import segmentation as P

RATE = 100


def loudness(values, frame_length, hop):
    half = frame_length // 2
    padded = np.concatenate([np.zeros(half), values, np.zeros(half)])
    starts = range(0, len(padded) - frame_length + 1, hop)
    return [math.sqrt(sum(padded[s : s + frame_length] ** 2) / frame_length) for s in starts]


def silence_loop(values, p):
    """Literal reading: visit the silent stretches in order, remember where the clip starts."""
    n = len(values)
    if -(-n // p["hop"]) <= p["min_length"]:
        return [(0, n)]
    rms = loudness(values, p["frame_length"], p["hop"])
    total, clip, tags, k = len(rms), 0, [], p["max_kept"]
    quiet = lambda a, b: a + int(np.argmin(rms[a:b]))
    frame = 0
    for silent, run in itertools.groupby(rms, lambda r: r < p["threshold"]):
        s, frame = frame, frame + len(list(run))
        i = frame
        if not silent:
            continue
        if i == total:
            if total - s >= p["min_interval"]:
                tags.append((quiet(s, min(total, s + k) + 1), total + 1))
            continue
        if not (s == 0 and i > k) and not (i - s >= p["min_interval"] and i - clip >= p["min_length"]):
            continue
        if i - s <= k:
            lo = hi = quiet(s, i + 1)
        else:
            lo, hi = quiet(s, s + k + 1), quiet(i - k, i + 1)
            if i - s <= 2 * k and s > 0:
                mid = quiet(i - k, s + k + 1)
                lo, hi = min(lo, mid), max(hi, mid)
        tags.append((0 if s == 0 else lo, hi))
        clip = hi
    if not tags:
        return [(0, n)]
    edges = [(0, tags[0][0])] if tags[0][0] > 0 else []
    edges += [(a[1], b[0]) for a, b in zip(tags, tags[1:])]
    if tags[-1][1] < total:
        edges.append((tags[-1][1], total))
    return [(a * p["hop"], min(n, b * p["hop"])) for a, b in edges]


def wave(seed, n):
    rng = random.Random(seed)
    out, loud = [], rng.random() < 0.5
    while len(out) < n:
        size = rng.choice([5, 20, 60, 150, 400])
        out += [rng.uniform(0.3, 1.0) * rng.choice([-1, 1]) if loud else rng.uniform(0, 0.02) for _ in range(size)]
        loud = not loud
    return [round(v, 4) for v in out[:n]]


@pytest.fixture(scope="module")
def waves():
    return {s: wave(s, n) for s, n in enumerate([900, 2500, 3300, 60, 1700])}


@pytest.fixture(scope="module")
def samples(spark, waves):
    rows = [(s, i, v) for s, w in waves.items() for i, v in enumerate(w)]
    return spark.createDataFrame(rows, "s int, i bigint, v double").cache()


def spans(df, *extra):
    out = {}
    for r in df.collect():
        out.setdefault(r.s, []).append((r.start, r.end))
    return {s: sorted(v) for s, v in out.items()}


@pytest.mark.parametrize("frame_length,hop", [(8, 2), (10, 3), (7, 4)])
def test_rms(spark, samples, waves, frame_length, hop):
    got = S.hopping_rms(samples, ["s"], "i", "v", frame_length, hop).collect()
    want = {(s, f): r for s, w in waves.items() for f, r in enumerate(loudness(np.array(w), frame_length, hop))}
    assert {(r.s, r.frame) for r in got} == set(want)
    assert all(abs(want[r.s, r.frame] - r.rms) < 1e-9 for r in got)


@pytest.mark.parametrize("rows_per_block", [30, 10**6])
def test_silence(samples, waves, rows_per_block):
    ms = dict(threshold_db=-20, min_length_ms=1000, min_interval_ms=200, hop_ms=20, max_kept_ms=300)
    got = spans(P.silence_plan(samples, ["s"], "i", "v", RATE, rows_per_block, **ms))
    p = S.silence_parameters(RATE, **ms)
    assert got == {s: sorted(silence_loop(np.array(w), p)) for s, w in waves.items()}


def cut_loop(n, rate, hop, lo_sec, hi_sec, choose):
    now, out = 0.0, []
    while True:
        if now + hi_sec >= n / rate:
            return [*out, (int(now * rate), n)]
        a, b = (int((now + d) * rate) // hop for d in (lo_sec, hi_sec))
        nxt = choose(a, b) * hop / rate
        out.append((int(now * rate), int(nxt * rate)))
        now = nxt


@pytest.mark.parametrize("rows_per_block", [40, 10**6])
@pytest.mark.parametrize("by_gap", [False, True])
def test_windowed_cuts(spark, samples, waves, rows_per_block, by_gap):
    hop, lo, hi = 4, 1.0, 3.0
    frames = S.hopping_rms(samples, ["s"], "i", "v", 16, hop).filter(F.col("samples") / RATE > hi)
    frames = frames.withColumn("on", F.col("rms") > 0.25)
    got = spans(S.windowed_cuts(frames, ["s"], RATE, hop, lo, hi, -15.0, "on" if by_gap else None, rows_per_block))
    want = {}
    for s, w in waves.items():
        if len(w) / RATE <= hi:
            continue
        rms = np.array(loudness(np.array(w), 16, hop))
        db = 20 * np.log10(np.maximum(rms, 1e-10))

        def choose(a, b):
            if by_gap:
                runs, at = [], a
                for on, g in itertools.groupby(rms[a:b] > 0.25):
                    size = len(list(g))
                    if not on:
                        runs.append((-size, at))
                    at += size
                if runs:
                    size, first = min(runs)
                    return first + -size // 2
            else:
                below = [f for f in range(a, b) if db[f] < -15.0]
                if below:
                    return below[-1]
            return a + int(np.argmin(db[a:b]))

        want[s] = cut_loop(len(w), RATE, hop, lo, hi, choose)
    assert got == want


def quiet_cut(db, limit):
    """Last frame below the limit in a window, else its quietest one."""

    def choose(a, b):
        below = [f for f in range(a, b) if db[f] < limit]
        return below[-1] if below else a + int(np.argmin(db[a:b]))

    return choose


@pytest.mark.parametrize("by_gap", [False, True])
@pytest.mark.parametrize("hi", [0.12, 0.4])
def test_cuts_move_on(samples, waves, hi, by_gap):
    """Windows that begin at the frame they are seen from, and at times hold no other."""
    hop, lo = 8, 0.05
    frames = S.hopping_rms(samples, ["s"], "i", "v", 16, hop).withColumn("on", F.lit(True))
    got = spans(S.windowed_cuts(frames, ["s"], RATE, hop, lo, hi, -200.0, "on" if by_gap else None, 40))
    want = {}
    for s, w in waves.items():
        rms = np.array(loudness(np.array(w), 16, hop))
        at, out = 0, []
        while at * hop / RATE + hi < len(w) / RATE:
            first, end = (int((at * hop / RATE + d) * RATE) // hop for d in (lo, hi))
            nxt = first + int(np.argmin(rms[first:end])) if first < end else end
            if nxt <= at:
                nxt = at + 1 + (int(np.argmin(rms[at + 1 : end])) if at + 1 < end else 0)
            out.append((int(at * hop / RATE * RATE), int(nxt * hop / RATE * RATE)))
            at = nxt
        want[s] = [*out, (int(at * hop / RATE * RATE), len(w))]
    assert got == want


def test_frames_beyond_the_longest_piece(samples):
    frames = S.hopping_rms(samples, ["s"], "i", "v", 256, 64)
    with pytest.raises(ValueError, match="no place for a cut"):
        S.windowed_cuts(frames, ["s"], RATE, 64, 0.2, 0.5, -30.0)


def merge_loop(parts, low, high):
    """Literal reading on (start, end) pairs in samples."""
    size = lambda p: (p[1] - p[0]) / RATE
    while True:
        out = [parts[0]]
        for p in parts[1:]:
            both = (out[-1][0], p[1])
            if size(out[-1]) < low and size(both) <= high:
                out[-1] = both
            else:
                out.append(p)
        if len(out) >= 2 and size(out[-1]) < low - 2.0 and size((out[-2][0], out[-1][1])) <= high:
            out = [*out[:-2], (out[-2][0], out[-1][1])]
        if len(out) == len(parts) or all(size(p) >= low for p in out):
            return out
        parts = out


@pytest.mark.parametrize("rows_per_block", [5, 10**6])
def test_merge_short(spark, rows_per_block):
    rng = random.Random(11)
    want, rows = {}, []
    for s in range(40):
        at, parts = 0, []
        for _ in range(rng.randint(1, 14)):
            at += rng.choice([0, 0, 50, 300])
            d = rng.choice([40, 90, 150, 250, 420, 700])
            parts.append((at, at + d))
            at += d
        rows += [(s, *p) for p in parts]
        want[s] = merge_loop(parts, 4.0, 9.0)
    df = spark.createDataFrame(rows, "s int, start bigint, end bigint")
    assert spans(S.merge_short(df, ["s"], RATE, 4.0, 9.0, rows_per_block)) == want


def tiny_loop(parts, tiny):
    out, head = [], None
    for a, b in parts:
        if b - a < tiny:
            if out:
                out[-1] = (out[-1][0], b)
            else:
                head = (head[0] if head else a, b)
        else:
            out.append((head[0] if head else a, b))
            head = None
    return out if head is None else [*out, head]


def stages_loop(w, lo, hi, silence_db, split_db, tiny, cut=True):
    """Silence split, cuts of long segments on frames of 20 ms, merges; without ``cut`` long segments stay."""
    p = S.silence_parameters(RATE, silence_db, 800, 200, 20, 100)
    parts = []
    for a, b in silence_loop(np.array(w), p):
        if (b - a) / RATE > hi and cut:
            db = 20 * np.log10(np.maximum(loudness(np.array(w[a:b]), 8, 2), 1e-10))
            parts += [(a + x, a + y) for x, y in cut_loop(b - a, RATE, 2, lo, hi, quiet_cut(db, split_db))]
        else:
            parts.append((a, b))
    return sorted(merge_loop(tiny_loop(parts, tiny * RATE), lo, hi))


@pytest.mark.parametrize("lo,hi,silence_db,split_db,tiny", [(0.2, 0.5, -40.0, -30.0, 0.35), (0.2, 0.5, -40.0, -30.0, 0.1), (0.5, 1.5, -20.0, -15.0, 0.35), (2.0, 6.0, -20.0, -30.0, 0.35)])
def test_three_stages(spark, waves, lo, hi, silence_db, split_db, tiny):
    rng = random.Random(5)
    series = waves | {10 + k: [round(rng.expovariate(10), 4) for _ in range(n)] for k, n in enumerate([30, 67, 75, 86, 99, 140, 400, 1500])}
    df = spark.createDataFrame([(s, i, v) for s, w in series.items() for i, v in enumerate(w)], "s int, i bigint, v double")
    got = spans(P.three_stage(df, ["s"], "i", "v", RATE, lo, hi, silence_db, split_db=split_db, tiny=tiny))
    bounds = (lo, hi, silence_db, split_db, tiny)
    assert got == {s: stages_loop(w, *bounds) for s, w in series.items()}
    # what the cuts give reaches the result
    assert got != {s: stages_loop(w, *bounds, cut=False) for s, w in series.items()}


def test_hop_of_windows():
    assert [P.window_hop(r, 8.0, 22.0) for r in (44100, 16000, 1000)] == [512, 512, 512]
    assert P.window_hop(100, 5.2, 11.0) == 512 and P.window_hop(16000, 5.0, 5.0, True) == 512
    assert P.window_hop(100, 0.2, 0.5) == 2 and P.window_hop(100, 6.0, 8.0) == 2 and P.window_hop(100, 0.01, 0.01) == 1


def test_methods(spark, samples, waves):
    whole = P.segment_series(samples, ["s"], "i", "v", RATE, "default")
    assert set(spans(whole)) == set(waves)
    loud = P.segment_series(samples, ["s"], "i", "v", RATE, "heuristic", 2.0, 6.0, rows_per_block=50)
    got = spans(loud)
    for s, parts in got.items():
        assert all(a < b for a, b in parts) and all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
    grid = P.grid_search(samples, ["s"], "i", "v", RATE, 2.0, 8.0)
    best = {}
    for i, (t, m) in enumerate(itertools.product((-45, -40, -35, -30, -25, -20), (8000, 6000, 4000, 2500, 1500))):
        p = S.silence_parameters(RATE, t, m, 200, 20, 500)
        for s, w in waves.items():
            parts = silence_loop(np.array(w), p)
            d = [(b - a) / RATE for a, b in parts]
            score = sum((2.0 - x) * 1.5 if x < 2.0 else max(0.0, x - 8.0) for x in d) + abs(len(d) - len(w) / RATE / 5.0) * 0.5
            if s not in best or score < best[s][0] - 1e-12:
                best[s] = (score, t, m, sorted(parts))
    rows = grid.collect()
    for s in waves:
        mine = [r for r in rows if r.s == s]
        assert {(r.threshold_db, r.min_length_ms) for r in mine} == {best[s][1:3]}
        assert sorted((r.start, r.end) for r in mine) == best[s][3]
    with pytest.raises(ValueError):
        P.segment_series(samples, ["s"], "i", "v", RATE, "nothing")


def test_score_and_statistics(spark):
    df = spark.createDataFrame([(1, 0, 300), (1, 300, 1000)], "s int, start bigint, end bigint")
    lengths = spark.createDataFrame([(1, 1000)], "s int, samples bigint")
    r = S.segmentation_score(df, lengths, ["s"], RATE, 4.0, 6.0).collect()[0]
    assert r.segments == 2 and abs(r.score - (1.5 + 1.0 + abs(2 - 2.0) * 0.5)) < 1e-9
    t = S.length_statistics(df, ["s"], RATE).collect()[0]
    assert (t.segments, t.min_len, t.max_len, t.avg_len) == (2, 3.0, 7.0, 5.0)
