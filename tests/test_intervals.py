import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals as I


def spans(rng, n, top=400, length=30):
    out = []
    for i in range(n):
        a = round(rng.uniform(0, top), 2)
        out.append((rng.randint(0, 2), i, a, round(a + rng.choice([length, length, 10 * length]) * rng.random() + 0.01, 2)))
    return out


@pytest.mark.parametrize("levels", [1, 3])
def test_overlap_join(spark, levels):
    rng = random.Random(2)
    a, b = spans(rng, 60), spans(rng, 70)
    left = spark.createDataFrame(a, "k int, i int, s double, e double")
    right = spark.createDataFrame(b, "k int, j int, p double, q double")
    got = sorted((r.i, r.j) for r in I.overlap_join(left, right, ["k"], ("s", "e"), ("p", "q"), 5.0, levels).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    plan = I.overlap_join(left, right, ["k"], ("s", "e"), ("p", "q"), 5.0, levels)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("levels", [1, 2])
def test_points_in_intervals(spark, levels):
    rng = random.Random(3)
    b = spans(rng, 50)
    pts = [(rng.randint(0, 2), round(rng.uniform(0, 420), 2)) for _ in range(120)]
    pts = sorted(set(pts))
    points = spark.createDataFrame(pts, "k int, t double")
    right = spark.createDataFrame(b, "k int, j int, p double, q double")
    got = I.points_in_intervals(points, right, ["k"], "t", ("p", "q"), "j", 7.0, levels, keep_unmatched=True)
    want = {}
    for k, t in pts:
        hits = [y[1] for y in b if y[0] == k and y[2] <= t < y[3]]
        want[k, t] = min(hits) if hits else None
    assert {(r.k, r.t): r.j for r in got.collect()} == want


@pytest.mark.parametrize("block", [6, 10**6])
def test_nearest(spark, block):
    rng = random.Random(4)
    marks = [(k, float(rng.randint(0, 100))) for k in (0, 1) for _ in range(15)]
    pts = [(k, i, float(rng.randint(-5, 105))) for k in (0, 1) for i in range(30)]
    got = I.nearest_times(
        spark.createDataFrame(pts, "k int, i int, t double"), spark.createDataFrame(marks, "k int, m double"),
        ["k"], "t", "m", rows_per_block=block,
    )
    for r in got.collect():
        own = sorted(m for k, m in marks if k == r.k)
        assert r.nearest == min(own, key=lambda m: abs(m - r.t))


def words_loop(word_dur, vuv, notes, durs, tol):
    import numpy as np

    wb, nb = np.cumsum([0.0, *word_dur]), np.cumsum([0.0, *durs])
    edges = [0.0]
    for raw, nxt in zip(wb[1:-1], wb[2:]):
        near = nb[np.argmin(abs(nb - raw))]
        want = near if abs(near - raw) <= tol else raw
        lo, hi = edges[-1] + 1e-4, nxt - 1e-4
        edges.append(min(max(want, lo), hi) if lo < hi else raw)
    edges.append(wb[-1])
    out = []
    for w, (a, b) in enumerate(zip(edges, edges[1:])):
        if b <= a:
            continue
        parts = []
        for label, x, y in zip(notes, nb, nb[1:]):
            d = min(b, y) - max(a, x)
            if d > 1e-4 and vuv[w]:
                if parts and parts[-1][0] == label:
                    parts[-1][1] += d
                else:
                    parts.append([label, d])
        for k, (label, d) in enumerate(parts or [["rest", b - a]]):
            out.append((w, k, label, d))
    return out


@pytest.mark.parametrize("block", [5, 10**6])
def test_notes_to_words(spark, block):
    rng = random.Random(8)
    w, n, want = [], [], {}
    for s in range(8):
        wd = [round(rng.choice([0.002, 0.01, 0.2, 0.35, 0.5]), 3) for _ in range(12)]
        vuv = [int(rng.random() < 0.8) for _ in wd]
        nd = [round(rng.choice([0.005, 0.1, 0.195, 0.205, 0.3]), 3) for _ in range(20)]
        nl = [rng.choice(["C4", "D4", "rest"]) for _ in nd]
        at = 0.0
        for i, d in enumerate(wd):
            w.append((s, i, at, at + d, vuv[i]))
            at += d
        at = 0.0
        for i, d in enumerate(nd):
            n.append((s, i, at, at + d, nl[i]))
            at += d
        want[s] = words_loop(wd, vuv, nl, nd, 0.01)
    words = spark.createDataFrame(w, "s int, idx int, start double, end double, v int")
    notes = spark.createDataFrame(n, "s int, idx int, start double, end double, label string")
    rows = I.notes_to_words(words, notes, ["s"], 0.3, voiced="v", rows_per_block=block).collect()
    for s in want:
        got = sorted((r.word, r.part, r.note, r.duration) for r in rows if r.s == s)
        assert [g[:3] for g in got] == [x[:3] for x in want[s]]
        assert all(abs(g[3] - x[3]) < 1e-9 for g, x in zip(got, want[s]))


@pytest.mark.parametrize("block", [2, 10**6])
def test_gap_filling(spark, block):
    df = spark.createDataFrame(
        [(1, 0, 0.05, 1.0, "a"), (1, 1, 1.08, 2.0, "b"), (1, 2, 2.5, 2.95, "c"), (2, 0, 0.5, 1.0, "d")],
        "s int, i int, a double, b double, w string",
    ).withColumn("len", F.lit(3.0))
    closed = I.close_small_gaps(df, ["s"], ["i"], "a", "b", "len", rows_per_block=block)
    assert sorted((r.s, r.a, r.b) for r in closed.collect()) == [(1, 0.0, 1.08), (1, 1.08, 2.0), (1, 2.5, 3.0), (2, 0.5, 1.0)]
    full = I.fill_complement(closed, ["s"], ["a"], "a", "b", "w", "len", rows_per_block=block)
    assert sorted((r.s, r.a, r.b, r.w) for r in full.collect()) == [
        (1, 0.0, 1.08, "a"), (1, 1.08, 2.0, "b"), (1, 2.0, 2.5, "SP"), (1, 2.5, 3.0, "c"),
        (2, 0.0, 0.5, "SP"), (2, 0.5, 1.0, "d"), (2, 1.0, 3.0, "SP"),
    ]
    ok = I.timeline_violations(full.withColumn("i", F.col("a")), ["s"], "i", "a", "b", "w")
    assert ok.count() == 0
    bad = I.timeline_violations(df, ["s"], "i", "a", "b", "w", rows_per_block=block).collect()
    assert [(r.s, r.i, r.rule) for r in bad] == [(1, 0, "contiguity")]


def test_subtract(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.5, 2.5), (1, 4.0, 5.0)], "s int, a double, b double")
    new = spark.createDataFrame([(1, 0, 0.95, 4.5), (1, 1, 6.0, 6.05), (1, 2, 4.2, 4.8), (2, 3, 0.0, 1.0)], "s int, i int, a double, b double")
    got = I.subtract_intervals(new, old, ["s"], "i", ("a", "b"), 1.0)
    assert sorted((r.i, r.a, r.b) for r in got.collect()) == [(0, 2.5, 4.0), (1, 6.0, 6.05), (3, 0.0, 1.0)]
    free, hit = I.insert_free(new, old, ["s"], "i", ("a", "b"), 1.0)
    assert sorted(r.i for r in free.collect()) == [1, 3] and sorted(r.i for r in hit.collect()) == [0, 2]


def repair_loop(rows):
    rows = [list(r) for r in rows]
    lex = [k for k, r in enumerate(rows) if r[3] not in ("SP", "AP")]
    if len(lex) < 3:
        return rows
    size = lambda k: max(0.0, rows[k][2] - rows[k][1])
    few = max(3, int(len(lex) * 0.15 + 0.999999))
    shortest = set(sorted(lex, key=size)[:few])
    gone = set()
    for p, c, n in zip(lex, lex[1:], lex[2:]):
        least = min(size(p), size(n))
        if c in shortest and least > 0 and size(c) < least * 0.6 and rows[n][1] > rows[c][2]:
            rows[c][2] = rows[n][1]
            gone |= set(range(c + 1, n))
    return [r for k, r in enumerate(rows) if k not in gone]


@pytest.mark.parametrize("block", [4, 10**6])
def test_repair_short(spark, block):
    rng = random.Random(9)
    data, want = [], set()
    for s in range(25):
        at, rows = 0.0, []
        for i in range(rng.randint(2, 25)):
            at = round(at + rng.choice([0, 0, 0.1]), 3)
            d = rng.choice([0.02, 0.05, 0.1, 0.3, 0.5])
            rows.append((i, at, round(at + d, 3), rng.choice(["x", "y", "SP"])))
            at = round(at + d, 3)
        data += [(s, *r) for r in rows]
        want |= {(s, *r) for r in map(tuple, repair_loop(rows))}
    df = spark.createDataFrame(data, "s int, i int, a double, b double, w string")
    assert {tuple(r) for r in I.repair_short(df, ["s"], "i", "a", "b", "w", rows_per_block=block).collect()} == want


@pytest.mark.parametrize("block", [3, 10**6])
def test_anchor_spans(spark, block):
    rows = [
        (1, 0, 0.0, 0.3, "SP", None), (1, 1, 0.3, 0.8, "ka", 0.4), (1, 2, 0.8, 1.2, "ki", 0.9), (1, 3, 1.2, 1.5, "SP", None),
        (1, 4, 1.5, 1.7, "k", None), (1, 5, 1.7, 2.0, "ku", 1.702), (1, 6, 2.0, 2.2, "AP", 2.1),
    ]
    df = spark.createDataFrame(rows, "s int, i int, a double, b double, w string, v double")
    out = I.anchor_spans(df, ["s"], "i", "a", "b", "w", "v", rows_per_block=block)
    got = [(r.i, r.part, round(r.duration, 6), r.voiced, r.label) for r in sorted(out.collect(), key=lambda r: (r.i, r.part))]
    assert got == [
        (0, 0, 0.3, 0, ""), (1, 0, 0.1, 0, ""), (1, 1, 0.5, 1, "ka"), (2, 1, 0.3, 1, "ki"), (3, 0, 0.3, 0, ""),
        (4, 0, 0.2, 0, ""), (5, 1, 0.298, 1, "ku"), (6, 0, 0.2, 0, ""),
    ]
    given = spark.createDataFrame([(1, 0, "か"), (1, 1, "き")], "s int, p int, t string")
    named = I.assign_in_order(out, given, ["s"], "p", "t").filter("voiced = 1").collect()
    assert sorted(r.label for r in named) == sorted(["か", "き", "ku"])


def test_children(spark):
    kind = "s int, a double, b double, c array<struct<start:double,end:double,text:string>>"
    df = spark.createDataFrame([(1, 0.0, 1.0, [(0.0, 0.4, "x"), (0.5, 0.5, "y"), (0.4, 1.2, "z"), (1.2, 1.3, "q")])], kind)
    r = I.accept_children(df, "a", "b", "c").collect()[0]
    assert [x.text for x in r.c] == ["x"] and [x.text for x in r.rejected] == ["y", "z", "q"]
    r = I.accept_children(df, "a", "b", "c", appended=True).collect()[0]
    assert [x.text for x in r.c] == ["x", "z", "q"] and r.b == 1.3
    r = I.move_edges(df, "a", "b", "c", F.lit(0.1), F.lit(1.1)).collect()[0]
    assert (r.a, r.b, r.start_rejected, r.end_rejected, r.c[0].start) == (0.1, 1.0, False, True, 0.1)
    good, bad = I.split_valid(spark.createDataFrame([(-1.0, 1.0), (2.0, 2.0)], "a double, b double"), "a", "b")
    assert good.collect()[0].a == 0.0 and bad.count() == 1


def test_reslice(spark):
    samples = spark.createDataFrame([(1, i) for i in range(100)], "s int, p bigint")
    ranges = spark.createDataFrame([(1, 0, 0.105, 0.2), (1, 1, 0.9, 0.5), (1, 2, 2.0, 1.0)], "s int, i int, o double, d double")
    cut, empty = I.reslice(samples, ranges, ["s"], "p", "o", "d", 100, 16)
    got = {r.i: (r.lo, r.hi, r.n) for r in cut.groupBy("i").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")).collect()}
    assert got == {0: (10, 29, 20), 1: (90, 99, 10)} and [r.i for r in empty.collect()] == [2]
