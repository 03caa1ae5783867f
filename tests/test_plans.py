import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.scoring import batched_scores, split_segments
from tidemark.operators.series import despike, event_rows, interpolate_linear, pad_to_longest, padded_chunks
from tidemark.plans.batch import plan_inputs, record_results, run_summary
from tidemark.plans.consensus import consensus_timeline, rebuild_increasing
from tidemark.plans.curves import pitch_curve
from tidemark.plans.passages import match_by_name, match_summary, prepare_corpus, shared_shingles


@pytest.mark.parametrize("block", [3, 10**6])
def test_rebuild(spark, block):
    rows = [(1, i, a, b) for i, (a, b) in enumerate([(0.0, 1.0), (0.5, 0.4), (0.9, 2.0), (3.0, 3.0)])]
    got = rebuild_increasing(spark.createDataFrame(rows, "s int, i int, a double, b double"), ["s"], "i", "a", "b", rows_per_block=block)
    out, before = [], 0.0
    for _, _, a, b in rows:
        s = max(a, before)
        before = max(s + 1e-4, b)
        out += [s, before]
    assert [x for r in sorted(got.collect(), key=lambda r: r.i) for x in (r.a, r.b)] == pytest.approx(out, abs=1e-9)


def test_consensus(spark):
    runs = []
    for run, shift in enumerate((0.0, 0.01, -0.01, 5.0)):
        runs += [(1, run, 0, 0.05, 1.0 + shift, "a"), (1, run, 1, 1.5 + shift, 2.0 + shift, "b")]
    runs += [(1, 9, 0, 0.0, 1.0, "z")]
    df = spark.createDataFrame(runs, "g int, run int, idx int, start double, end double, label string")
    got = consensus_timeline(df, ["g"], spark.createDataFrame([(1, 3.0)], "g int, length double")).collect()
    rows = sorted((round(r.start, 3), round(r.end, 3), r.label) for r in got)
    assert rows == [(0.0, 1.0, "a"), (1.0, 1.5, "SP"), (1.5, 2.0, "b"), (2.0, 3.0, "SP")]


def test_pitch_curve(spark):
    track = [(1, i, 60.2 if i % 7 else None) for i in range(100)]
    notes = [(1, 0, 0.0, 0.5, 60.0), (1, 1, 0.5, 1.0, 61.0)]
    got = pitch_curve(
        spark.createDataFrame(track, "s int, frame bigint, pitch double"),
        spark.createDataFrame(notes, "s int, idx int, onset double, offset double, note_pitch double"),
        ["s"], 0.01, 120.0, 0.5,
    ).collect()
    assert {r.y for r in got} == {20, -80} and all(r.x % 5 == 0 for r in got)
    xs = sorted(r.x for r in got)
    assert xs[0] == 30 and xs == sorted(set(xs)) and min(b - a for a, b in zip(xs, xs[1:])) == 5


def test_pitch_curve_counts_rows_once(spark, monkeypatch):
    from tidemark import scan

    track = spark.createDataFrame([(1, f, 60.0 + f % 3) for f in range(40)], "s int, frame bigint, pitch double")
    notes = spark.createDataFrame([(1, 0, 0.0, 1.0, 60.0), (1, 1, 1.0, 2.0, 60.0)], "s int, idx int, onset double, offset double, note_pitch double")
    whole = sorted(map(tuple, pitch_curve(track, notes, ["s"], 0.05, 120.0, 1.0).collect()))
    assert whole == sorted(map(tuple, pitch_curve(track, notes, ["s"], 0.05, 120.0, 1.0, rows_per_block=26).collect()))
    counted, stage = [], scan.stage
    monkeypatch.setattr(scan, "stage", lambda df: counted.append(1) or stage(df))
    curve = pitch_curve(track, notes, ["s"], 0.05, 120.0, 1.0)
    plan = curve._jdf.queryExecution().optimizedPlan().toString()
    assert len(counted) == 1 and "collect_list" not in plan


@pytest.mark.parametrize("batch", [7, 10_000])
def test_despike_by_hand(spark, batch):
    rng = random.Random(8)
    rows = [(s, i, float(rng.choice([0, 10, 40, 300, 301]))) for s, n in enumerate([1, 2, 3, 60, 200]) for i in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.s, r.i): r.smoothed for r in despike(spark.createDataFrame(rows, "s int, i int, v double"), ["s"], ["i"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(s, i): v for s, i, v in rows}
    for s, i, v in rows:
        if (s, i - 1) in want and (s, i + 1) in want:
            off = v - (want[s, i - 1] + want[s, i + 1]) / 2
            want[s, i] = round(v - off * 0.7) if abs(off) > 75 else v
    assert got == want


def test_despike_and_fill(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 200, 0, 0, 300, 0])], "s int, i int, v int")
    got = [r.smoothed for r in sorted(despike(df, ["s"], ["i"], "v").collect(), key=lambda r: r.i)]
    assert got == [0, 60, 0, 105, 127, 0]
    gaps = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, float("nan"), 4.0, None])], "s int, i int, v double")
    for block in (2, 10**6):
        got = interpolate_linear(gaps, ["s"], "i", "v", rows_per_block=block).collect()
        assert [r.filled for r in sorted(got, key=lambda r: r.i)] == pytest.approx([1, 1, 2, 3, 4, 4])


@pytest.mark.parametrize("block", [2, 10**6])
def test_events_and_chunks(spark, block):
    rows = [(1, 0, 10, 5), (1, 1, 8, 30), (1, 2, 40, 41), (1, 3, 40, 40)]
    got = event_rows(spark.createDataFrame(rows, "s int, i int, a bigint, b bigint"), ["s"], ["i"], "a", "b", block).collect()
    by = {(r.i, r.kind): (r.tick, r.delta) for r in got}
    want, at = {}, 0
    for _, i, a, b in rows:
        s = max(a, at)
        e = b if b > s else s + 1
        want[i, "on"], want[i, "off"] = (s, s - at), (e, e - s)
        at = e
    assert by == want
    chunks = padded_chunks(spark.createDataFrame([(1, p, float(p)) for p in range(5)], "s int, p bigint, v double"), ["s"], "p", "v", 3)
    assert {r.chunk: (r["values"], r.used) for r in chunks.collect()} == {0: ([0.0, 1.0, 2.0], 3), 1: ([3.0, 4.0, 0.0], 2)}


def test_matching_by_name(spark):
    song = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf"
    refs = spark.createDataFrame([("a_b", song)], "song string, text string")
    ins = spark.createDataFrame([("a_b_1", "Brown fox jumps!"), ("a_b_2", "lazy dog ran runs far"), ("a_b_3", "zzz qqq"), ("x_1", "fox")], "name string, text string")
    matches, missing = match_by_name(ins, refs, "en", threshold=2)
    got = {r.name: (r.status, r.exact) for r in matches.collect()}
    # commas and marks are no tokens, so the first input is verbatim
    assert got["a_b_1"] == ("matched", True) and got["a_b_2"][1] is False and got["a_b_3"] == ("no_match", False)
    assert [r.song for r in missing.collect()] == ["x"]
    r = match_summary(matches).collect()[0]
    assert (r.total, r.no_match, r.exact) == (3, 1, 1)
    docs = prepare_corpus(spark.createDataFrame([(1, song), (2, "nothing here")], "d int, t string"), "t", "en")
    parts = prepare_corpus(spark.createDataFrame([(7, "fox jumps over the lazy dog and runs quickly")], "p int, t string"), "t", "en")
    assert [(r.p, r.d) for r in shared_shingles(parts, docs, "p", "d", "tokens").collect()] == [(7, 1)]


def test_scoring(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "i int, t string").coalesce(1)

    def lengths(batch):
        if "xxxxx" in batch:
            raise RuntimeError("bad batch")
        return [len(t) for t in batch]

    got = {r.i: (r.score, r.error) for r in batched_scores(df, "t", lengths, "int", 4).collect()}
    assert got[2] == (2, None) and got[6] == (None, "RuntimeError: bad batch") and got[9] == (9, None)
    s = spark.createDataFrame([(1, 100, i, 0.0) for i in range(6)], "s int, seg bigint, at bigint, v double")
    halves = lambda v: [(0, len(v) // 2), (len(v) // 2, len(v))]
    assert sorted((r.start, r.end) for r in split_segments(s, ["s"], "seg", "at", "v", 10.0, halves).collect()) == [(100, 103), (103, 106)]


def test_split_in_blocks(spark):
    rng = random.Random(7)

    def runs(v):
        edges = [i for i in range(len(v) + 1) if (i < len(v) and v[i] > 0) != (i > 0 and v[i - 1] > 0)]
        return list(zip(edges[::2], edges[1::2]))

    lengths = {(1, 0): 1, (1, 100): 60, (2, 0): 7, (2, 50): 200}
    rows = [(s, seg, i, float(seg == 50 and 20 < i < 150 or rng.random() < 0.6)) for (s, seg), n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "s int, seg bigint, at bigint, v double")
    whole = sorted(map(tuple, split_segments(df, ["s"], "seg", "at", "v", 10.0, runs).collect()))
    for block in (1, 8, 60):
        assert sorted(map(tuple, split_segments(df, ["s"], "seg", "at", "v", 10.0, runs, block, 1).collect())) == whole


def test_pad_to_longest(spark):
    rows = [(1, [1, 2, 3], ["a", "b", "c"], "x"), (1, [4], ["d"], "y"), (1, None, None, "z"), (2, [], [], "w"), (None, [5, 6], ["e", "f"], "v"), (None, [7], ["g"], "u")]
    df = spark.createDataFrame(rows, "g int, ids array<int>, names array<string>, k string")
    got = {r.k: (r.ids, r.names, r.length, r.mask) for r in pad_to_longest(df, ["g"], {"ids": -1, "names": "-"}).collect()}
    assert got["x"] == ([1, 2, 3], ["a", "b", "c"], 3, [1, 1, 1]) and got["y"] == ([4, -1, -1], ["d", "-", "-"], 1, [1, 0, 0])
    assert got["z"] == ([-1] * 3, ["-"] * 3, 0, [0, 0, 0]) and got["w"] == ([], [], 0, []) and got["u"] == ([7, -1], ["g", "-"], 1, [1, 0])


def test_batch_plan(spark):
    files = spark.createDataFrame([("/a.wav", "a.wav", "a", b"1"), ("/b.wav", "b.wav", "b", b"2")], "path string, name string, stem string, content binary")
    manifest = spark.createDataFrame([], "md5 string, output_key string, source_name string, source_path string, chunks int, labs int, seq bigint")
    outputs = spark.createDataFrame([], "output_key string")
    planned = plan_inputs(files, manifest, outputs)
    results = planned.withColumn("chunks", F.lit(2)).withColumn("labs", F.lit(1)).withColumn("error", F.when(F.col("stem") == "b", "x"))
    after = record_results(manifest, results, 1)
    assert [r.source_name for r in after.collect()] == ["a.wav"]
    again = plan_inputs(files, after, after.select("output_key"))
    assert [r.stem for r in again.collect()] == ["b"]
    got = {r.measure: r.n for r in run_summary(files, again, results).collect()}
    assert got == {"files": 2, "skipped": 1, "failed": 1, "chunks": 4, "labs": 2}


def test_places_come_with_their_tokens(spark):
    from tidemark.operators.match import best_windows

    rows = [(1, list("bcd"), list("abcde")), (2, list("xyz"), list("abcde")), (3, list("bcx"), list("aabcda")), (4, list("ab"), None)]
    pairs = spark.createDataFrame(rows, "k int, input array<string>, reference array<string>")
    got = {r.k: r for r in best_windows(pairs, ["k"], cut=True).collect()}
    assert got[1].window == list("bcd") and got[1].exact and got[2].window == [] and got[4].window == []
    for k, heard, reference in rows:
        assert got[k].input == heard and got[k].window == ((reference or [])[got[k].start : got[k].end] if got[k].start >= 0 else [])


def test_scores_without_the_text(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "i int, t string").coalesce(1)

    def words(batch):
        return [None if t is None else len(t.split()) for t in batch]

    out = batched_scores(df, "t", words, "int", 2, keep=["i"])
    assert out.columns == ["i", "score", "error"]
    assert [tuple(r) for r in out.orderBy("i").collect()] == [(1, 2, None), (2, None, None), (3, 1, None)]
