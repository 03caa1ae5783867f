import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import ingest, state, windows

EVENT = "task_id string, ts timestamp, seq bigint, kind string, progress int, stage string, message string"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def feed(spark, folder, rows, schema, part):
    df = spark.createDataFrame(rows, schema)
    for c, t in df.dtypes:
        if c == "ts":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")


def run(spark, build, batches, schema=EVENT, mode="append"):
    folder, name = fresh(), f"t{abs(hash(str(batches))) % 10**8}_{mode}_{build.__name__}"
    text_schema = schema.replace("ts timestamp", "ts string")
    for i, rows in enumerate(batches):
        feed(spark, folder, rows, text_schema, i)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", fresh()).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def ev(task, second, kind, progress=0, stage="", message=""):
    return (task, f"2024-01-01 00:{second // 60:02d}:{second % 60:02d}", second, kind, progress, stage, message)


def test_lifecycle(spark):
    batches = [
        [ev("a", 0, "create"), ev("a", 1, "start"), ev("a", 2, "progress", 40, "slicing"), ev("b", 1, "stop"), ev("b", 2, "start")],
        [ev("a", 5, "done"), ev("b", 5, "stop"), ev("b", 6, "error", message="late"), ev("c", 6, "start"), ev("c", 7, "error", message="boom"), ev("c", 8, "done")],
    ]
    rows = run(spark, state.job_lifecycle, batches)
    last = {}
    for r in sorted(rows, key=lambda r: r.ts):
        last[r.task_id] = (r.status, r.progress, r.stage, r.error)
    assert last["a"] == ("completed", 100, "done", None)
    assert last["b"][0] == "cancelled" and last["b"][3] is None
    assert last["c"][0] == "failed" and last["c"][3] == "boom"


def test_progress_backlog_holdback(spark):
    batches = [[ev("a", i, "log", p, message=f"m{i}") for i, p in enumerate((10, 60, 30))], [ev("a", 5, "log", 100, message="m5"), ev("a", 6, "log", 20, message="m6")]]
    rows = run(spark, state.monotone_progress, batches, mode="update")
    assert sorted(r.progress for r in rows) == [60, 99]

    def last_three(s):
        return state.backlog(s, 3)

    def held(s):
        return state.hold_back(s, 2)

    rows = run(spark, last_three, batches, mode="update")
    assert [r.message for r in rows][-3:] == ["m2", "m5", "m6"]
    rows = run(spark, held, batches)
    assert [r.message for r in rows] == ["m0", "m1", "m2"]


def test_timeout(spark):
    batches = [[ev("a", 0, "log"), ev("b", 0, "log")], [ev("b", 50, "log")], [ev("b", 200, "log")], [ev("b", 210, "log")]]

    def silent(s):
        return state.silence_timeouts(s, 100)

    rows = run(spark, silent, batches)
    assert ("a", "timed_out") in {(r.task_id, r.status) for r in rows}


def test_windows(spark):
    schema = "k int, ts timestamp, v double"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [[(1, at(0), 3.0), (1, at(5), 4.0), (2, at(3), 1.0)], [(1, at(60), 2.0), (1, at(1), 9.0)], [(1, at(300), 1.0)], [(1, at(2), 7.0), (1, at(301), 1.0)]]

    def sessions(s):
        return windows.gap_sessions(s, ["k"], "ts", "v", "10 minutes", "30 minutes")

    rows = run(spark, sessions, batches, schema)
    got = {(r.k, r.start.minute + 60 * r.start.hour): r.n for r in rows}
    assert got == {(1, 0): 3, (2, 3): 1, (1, 60): 1}

    def energy(s):
        return windows.hopping_energy(s, ["k"], "ts", "v", "10 minutes", "5 minutes", "30 minutes")

    rows = run(spark, energy, batches, schema)
    assert any(r.k == 1 and r.n == 2 and abs(r.rms - ((9 + 81) / 2) ** 0.5) < 1e-9 for r in rows)


def test_log_lines(spark):
    rows = run(spark, lambda_lines, [[(1, "at 45%x\r\n\nready"), (2, "  failed ")]], "k int, t string")
    assert sorted((r.k, r.line, r.level, r.percent) for r in rows if r.percent is None) == [(1, "ready", "success", None), (2, "failed", "error", None)]
    assert [(r.line, r.percent) for r in rows if r.percent] == [("at 45%x", 45)]


def lambda_lines(s):
    return windows.log_lines(s, "t")


def test_ingest(spark):
    folder, out = fresh(), fresh()
    write = lambda name, data: open(f"{folder}/{name}", "wb").write(data)
    write("a.wav", b"1"), write("b.wav", b"1"), write("c.wav", b"2")

    def once():
        files = ingest.file_stream(spark, folder)
        q = ingest.ingest_new(files, lambda df: df.select("md5", F.length("content").alias("n")), f"{out}/manifest", f"{out}/rows", f"{out}/check")
        q.awaitTermination(120)
        return spark.read.parquet(f"{out}/rows").count()

    assert once() == 2
    write("d.wav", b"2"), write("e.wav", b"3")
    assert once() == 3
    assert spark.read.parquet(f"{out}/manifest").count() == 3


def test_timer_releases_what_is_held(spark):
    batches = [
        [ev("a", i, "log", message=f"m{i}") for i in range(4)] + [ev("b", 0, "log", message="x")], [ev("b", 50, "log", message="y")],
        [ev("b", 400, "log", message="z")], [ev("b", 401, "log", message="w")], [ev("a", 402, "log", message="m402")],
    ]

    def held(s):
        return state.hold_back(s, 2, 100)

    rows = run(spark, held, batches)
    # the last two of "a" come by the timer, before "a" goes on
    assert [r.message for r in rows if r.task_id == "a"][:4] == ["m0", "m1", "m2", "m3"]
    assert [r.message for r in rows if r.task_id == "b"][:2] == ["x", "y"]
    assert len({(r.task_id, r.seq) for r in rows}) == len(rows)


def test_snapshot_after_a_restart(spark):
    first = [ev("a", 0, "start"), ev("a", 1, "progress", 40, "cut", "p40"), ev("b", 0, "log", message="b0")]
    second = [ev("a", 2, "progress", 30, "cut", "p30"), ev("c", 2, "start"), ev("c", 3, "error", message="boom")]
    text_schema = EVENT.replace("ts timestamp", "ts string")

    def final(parts):
        source, out, check = fresh(), fresh(), fresh()
        for i, batches in enumerate(parts):
            for j, rows in enumerate(batches):
                feed(spark, source, rows, text_schema, f"{i}{j}")
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
            state.publish_snapshots(stream, out, check, 2).awaitTermination(120)
        status, rows = state.read_snapshot(spark, out)
        got = sorted(map(tuple, status.collect())), sorted((r.task_id, r.seq, r.message) for r in rows.collect())
        # rows of a batch that did not come to its end are not seen
        spark.read.parquet(f"{out}/rows/batch=0").write.partitionBy("part").parquet(f"{out}/rows/batch=99")
        assert sorted(map(tuple, state.read_snapshot(spark, out)[0].collect())) == got[0]
        return got

    whole, parts = final([[first, second]]), final([[first], [second]])
    assert whole == parts
    assert whole[0] == [("a", "running", 40, "cut", None, 3), ("b", "pending", 0, "idle", None, 1), ("c", "failed", 0, "idle", "boom", 2)]
    assert whole[1] == [("a", 1, "p40"), ("a", 2, "p30"), ("b", 0, "b0"), ("c", 2, ""), ("c", 3, "boom")]


def test_live_segments(spark):
    schema = "task_id string, ts timestamp, seq bigint, value double"
    at = lambda k, s, v=1.0: (k, f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}", s, v)
    batches = [
        [at("a", 0), at("a", 5), at("a", 9), at("b", 3)], [at("a", 30), at("a", 31), at("b", 40)],
        # late, but not behind the watermark
        [at("a", 34), at("a", 25), at("b", 41)], [at("z", 3000)], [at("z", 3001)],
    ]

    def live(s):
        return state.live_segments(s, 10, 3, "20 seconds")

    got = {(r.task_id, r.seq): (r.seg_id, r.row_in_seg) for r in run(spark, live, batches, schema) if r.task_id != "z"}
    want = {}
    for k in "ab":
        seconds, last, seg, row = sorted({r[2] for b in batches for r in b if r[0] == k}), None, -1, 0
        for s in seconds:
            seg, row = (seg + 1, 0) if last is None or s - last >= 10 or row == 2 else (seg, row + 1)
            want[k, s], last = (seg, row), s
    assert got == want


def test_silence_within_a_batch(spark):
    batches = [[ev("a", 0, "log"), ev("a", 300, "log")], [ev("b", 900, "log")], [ev("b", 901, "log")]]

    def silent(s):
        return state.silence_timeouts(s, 100)

    # whether two rows come in one batch or in two, the silence between them is reported
    assert sorted(r.last.minute * 60 + r.last.second for r in run(spark, silent, batches) if r.task_id == "a") == [0, 300]


def test_slices_of_several_files(spark, monkeypatch):
    from catalog import QUERIES, streams

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 60)
    stream, base = streams._feed(spark, folder)
    sizes = {k: len(spark.read.parquet(f"{base}/feed/slice={k}").inputFiles()) for k in range(streams.SLICES + 1 + len(streams.AFTER))}
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    assert set(sizes.values()) == {-(-rows // (streams.SLICES * 60))} and sizes[0] > 1
    fed = spark.read.schema(streams.FEED).parquet(f"{base}/feed/slice=*").filter(f"user_id != {streams.CLOSING}")
    assert fed.filter("event_type != 'end'").count() == rows
    got = {tuple(r) for r in QUERIES["stream_snapshot"](spark, folder).collect()}
    monkeypatch.undo()
    assert got == {tuple(r) for r in QUERIES["stream_snapshot"](spark, folder).collect()}
