import random

from pyspark.sql import functions as F

from tidemark.chain import greedy_chain
from tidemark.operators import islands as I
from tidemark.scan import with_blocks

BLOCKS = (4, 10**6)


def notes(seed, n=50, series=3):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        t = 0
        for i in range(n if s else 2 * n):
            t += rng.choice([0, 0, 0, 5, 40, 300])
            d = rng.randint(1, 60)
            rows.append((s, i, t, t + d, rng.choice(["-", "-", "la"])))
            t += d - (rng.random() < 0.1)
    return rows


def test_greedy_chain(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for s in range(3):
        at = sorted(rng.sample(range(300), 80))
        nodes = [(s, p, p + rng.randint(1, 20), 7) for p in at]
        rows += nodes
        reach = 7
        for _, p, r, _ in nodes:
            if p >= reach:
                want.add((s, p))
                reach = r
    df = spark.createDataFrame(rows, "s int, p bigint, r bigint, root bigint")
    assert {(r.s, r.p) for r in greedy_chain(df, ["s"], "p", "r", "root", 20).collect()} == want
    blocked = with_blocks(df, ["s"], "p", 9)
    assert {(r.s, r.p) for r in greedy_chain(blocked, ["s"], "p", "r", "root", 20).collect()} == want


def test_gap_or_cap(spark):
    rows = notes(2)
    df = spark.createDataFrame(rows, "s int, i int, a bigint, b bigint, w string")
    want = {}
    for s in {r[0] for r in rows}:
        seg, size, before = -1, 0, None
        for r in [r for r in rows if r[0] == s]:
            if before is None or r[2] - before >= 240 or size == 7:
                seg, size = seg + 1, 0
            size += 1
            before = r[3]
            want[s, r[1]] = seg
    for n in BLOCKS:
        got = I.gap_or_cap_segments(df, ["s"], "a", "b", ["a", "i"], 240, 7, rows_per_block=n).collect()
        assert {(r.s, r.i): r.seg_id for r in got} == want


def test_tied_phrases(spark):
    rows = notes(4, n=80)
    df = spark.createDataFrame(rows, "s int, i int, a bigint, b bigint, w string")
    want = {}
    for s in {r[0] for r in rows}:
        seg, first, prev = 0, 0, None
        for k, r in enumerate([r for r in rows if r[0] == s]):
            if prev is not None:
                gap = r[2] - prev[3]
                free = gap > 0 and "-" not in (prev[4], r[4])
                if gap >= 60 or free or (k - first >= 16 and gap >= 0):
                    seg, first = seg + 1, k
            want[s, r[1]] = seg
            prev = r
    for n in BLOCKS:
        got = I.tied_phrases(df, ["s"], "a", "b", "w", ["i"], 60, rows_per_block=n).collect()
        assert {(r.s, r.i): r.seg_id for r in got} == want


def test_threshold_runs(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for s in range(6):
        on, values = True, []
        while len(values) < 120:
            values += [0.9 if on else 0.1] * rng.randint(1, 16 if on else 9)
            on = not on
        rows += [(s, i, v) for i, v in enumerate(values)]
        # literal reading: mark misses, close a run at the sixth miss in a row
        first, misses = None, 0
        for i, v in enumerate(values):
            if v >= 0.5:
                first, misses = (i if first is None else first), 0
            elif first is not None:
                misses += 1
                if misses > 5:
                    last = i - misses
                    if last - first >= 10:
                        want.add((s, first, last))
                    first, misses = None, 0
        if first is not None and len(values) - first >= 10:
            want.add((s, first, len(values) - 1))
    df = spark.createDataFrame(rows, "s int, i int, v double")
    for n in BLOCKS:
        got = I.threshold_runs(df, ["s"], "i", "v", 0.5, rows_per_block=n)
        assert {tuple(r) for r in got.collect()} == want


def test_merges(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.1), (1, 0.2, 0.3), (1, 0.5, 2.0), (1, 2.5, 2.6), (1, 3.0, 5.0), (2, 0.0, 0.1), (2, 1.0, 1.1)],
        "s int, a double, b double",
    )
    for n in (2, 100):
        got = sorted((r.s, r.seg_id, r.a, r.b, r.parts) for r in I.merge_tiny(df, ["s"], "a", "b", 0.35, n).collect())
        assert got == [(1, 0, 0.0, 2.6, 4), (1, 1, 3.0, 5.0, 1), (2, 0, 0.0, 1.1, 2)]
    flags = spark.createDataFrame([(1, i, f, 1.0) for i, f in enumerate([0, 0, 1, 1, 0])], "s int, i int, f int, d double")
    got = I.merge_equal_flags(flags, ["s"], ["i"], "f", "d", F.col("f") == 0, 2)
    assert sorted((r.run_id, r.f, r.d) for r in got.collect()) == [(0, 0, 2.0), (1, 1, 1.0), (2, 1, 1.0), (3, 0, 1.0)]


def test_repeats(spark):
    ids = [5, 5, 0, 5, 7, 7, 0, 0, 7]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(ids)], "s int, i int, v int")
    for n in (2, 100):
        got = I.collapse_repeats(df, ["s"], ["i"], "v", 0, n).collect()
        assert [r.v for r in sorted(got, key=lambda r: r.i)] == [5, 5, 7, 7]
    words = spark.createDataFrame([(1, i, "ab"[i % 2]) for i in range(20)] + [(2, i, str(i)) for i in range(20)], "s int, i int, v string")
    for n in (3, 100):
        assert I.degenerate_rows(words, ["s"], ["i"], "v", rows_per_block=n).count() == 5
        assert I.number_batches(words, ["s"], ["i"], 8, n).groupBy("s", "batch").count().count() == 6


def test_anchored_runs(spark):
    rows = [(1, 0, 0.0, 1.0, 60.0, "la"), (1, 1, 1.0, 2.0, 60.06, "-"), (1, 2, 2.0, 3.0, 60.12, "-"), (1, 3, 3.0, 4.0, 60.15, "-"), (1, 4, 4.5, 5.0, 60.15, "-"), (1, 5, 5.0, 6.0, 60.15, "di")]
    df = spark.createDataFrame(rows, "s int, i int, a double, b double, v double, w string")
    for n in (2, 100):
        got = I.anchored_runs(df, ["s"], "a", "b", "v", "w", ["i"], rows_per_block=n).collect()
        assert sorted((r.a, r.b, r.v, r.w) for r in got) == [(0.0, 2.0, 60.0, "la"), (2.0, 4.0, 60.12, "-"), (4.5, 5.0, 60.15, "-"), (5.0, 6.0, 60.15, "di")]


def test_degenerate_places_of_arrays(spark):
    from tidemark.operators.islands import degenerate_places

    rows = [(1, ["a"] * 15), (2, ["a", "b", "c", "d"] * 4 + ["a", "b"] * 10), (3, list("abcdefghijklmnopqrst")), (4, None)]
    got = {r.k: r.p for r in spark.createDataFrame(rows, "k int, l array<string>").select("k", degenerate_places("l").alias("p")).collect()}
    for k, l in rows:
        l = l or []
        assert got[k] == [i for i in range(16, len(l) + 1) if len(set(l[i - 15 : i])) <= 3]
