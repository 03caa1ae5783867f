"""Keyed state: job lifecycle, progress, backlog, time-outs and hold-back.

State per key is bounded: one record, or a list of fixed length.  All that is kept of a key is one value, lists as its
arrays, so a key costs one read and one write a batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

BACKLOG = 500
TIMEOUT_SECONDS = 600
LIFECYCLE_SCHEMA = "task_id string, status string, progress int, stage string, error string, ts timestamp"
# Job states.
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"


# Last rows of a key, as they are kept: one array a column.
HELD = "us array<bigint>, seq array<bigint>, message array<string>"


def _in_order(rows: Iterator[Row]) -> list[Row]:
    """Rows ``(task_id, us, seq, ...)`` by time; one without a time comes last."""
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2]))


def next_status(status: str, stopping: bool, kind: str) -> tuple[str, bool]:
    """State and stop flag after an event; events that do not fit change nothing."""
    if kind == "start" and status == PENDING:
        return RUNNING, False
    if status != RUNNING:
        return status, stopping
    if kind == "stop":
        return status, True
    if kind == "interrupt":
        return CANCELLED, stopping
    if kind in ("done", "error"):
        return (CANCELLED if stopping else COMPLETED if kind == "done" else FAILED), stopping
    return status, stopping


class _Lifecycle(StatefulProcessor):
    """Follows ``create, start, stop, progress, done, error, interrupt`` events of a job."""

    COLUMNS = ("kind", "progress", "stage", "message")
    _row = Row("task_id", "status", "progress", "stage", "error", "us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("job", "status string, stopping boolean, progress int, stage string, error string")

    def handleInputRows(self, key, rows, timerValues):
        status, stopping, progress, stage, error = self._state.get() or (PENDING, False, 0, "idle", None)
        out = []
        for _, us, _, kind, new_progress, new_stage, message, *_ in _in_order(rows):
            before = (status, progress, stage)
            if kind == "progress" and status == RUNNING:
                progress, stage = int(new_progress), new_stage
            status, stopping = next_status(status, stopping, kind)
            if status == COMPLETED and before[0] == RUNNING:
                progress, stage = 100, "done"
            if status == FAILED and before[0] == RUNNING:
                error = message
            if (status, progress, stage) != before or kind == "create":
                out.append(self._row(key[0], status, progress, stage, error, us))
        self._state.update((status, stopping, progress, stage, error))
        return iter(out)

    def close(self) -> None:
        pass


class _Progress(StatefulProcessor):
    """Largest progress so far, at most 99 until the job is done."""

    COLUMNS = ("kind", "progress")
    _row = Row("task_id", "progress")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._best = handle.getValueState("best", "progress int")

    def handleInputRows(self, key, rows, timerValues):
        known = self._best.get()
        best, done = known[0] if known else 0, False
        for _, _, _, kind, progress, *_ in rows:
            done = done or kind == "complete"
            best = max(best, min(99, best if progress is None else int(progress)))
        best = 100 if done else best
        self._best.update((best,))
        yield self._row(key[0], best)

    def close(self) -> None:
        pass


class _Backlog(StatefulProcessor):
    """The last events of a key, replayed whenever new ones arrive."""

    COLUMNS = ("message",)
    _row = Row("task_id", "us", "seq", "message")

    def __init__(self, size: int):
        self._size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._rows = handle.getValueState("rows", HELD)

    def handleInputRows(self, key, rows, timerValues):
        kept = _held(self._rows.get()) + [(r[1], r[2], r[3]) for r in _in_order(rows)]
        kept = sorted(kept, key=lambda r: (r[0], r[1]))[-self._size :]
        self._rows.update(_arrays(kept))
        yield self._row(key[0], *_arrays(kept))

    def close(self) -> None:
        pass


def _held(known: tuple | None) -> list[tuple]:
    """The rows of a value whose first parts are the arrays of ``HELD``."""
    return list(zip(*known[:3])) if known else []


def _arrays(rows: Sequence[tuple], columns: int = 3) -> tuple[list, ...]:
    return tuple([list(c) for c in zip(*rows)] or [[] for _ in range(columns)])


class _HoldBack(StatefulProcessor):
    """Releases a row once ``size`` later rows of its key have arrived, and all at the row of kind ``end``.

    With ``seconds`` a key that stays silent that long in event time releases what it holds as well.
    """

    COLUMNS = ("message", "kind")
    _row = Row("task_id", "us", "seq", "message")

    def __init__(self, size: int, seconds: int | None = None):
        self._size, self._ms = size, None if seconds is None else seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getValueState("rows", f"{HELD}, timer bigint")

    def _keep(self, held: list[tuple], timer: int | None) -> None:
        """Store what is held; one timer is set while there is any, no later than the newest row is due."""
        if held and self._ms is not None and timer is None:
            timer = self._due(held)
            self._handle.registerTimer(timer)
        if held or timer is not None:
            self._rows.update((*_arrays(held), timer))
        else:
            self._rows.clear()

    def _due(self, held: list[tuple]) -> int:
        return max(r[0] for r in held) // 1000 + self._ms

    def handleInputRows(self, key, rows, timerValues):
        known = self._rows.get()
        held, new = _held(known), _in_order(rows)
        ends = any(r[4] == "end" for r in new)
        held += [(r[1], r[2], r[3]) for r in new if r[4] != "end"]
        ready, held = (held[: -self._size], held[-self._size :]) if self._size and not ends else (held, [])
        self._keep(held, known[3] if known else None)
        if ready:
            yield self._row(key[0], *_arrays(ready))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = _held(self._rows.get())
        # newer rows have come since the timer was set: it follows them now
        ready, held = ([], held) if held and self._due(held) > timerValues.getCurrentWatermarkInMs() else (held, [])
        self._keep(held, None)
        if ready:
            yield self._row(key[0], *_arrays(ready))

    def close(self) -> None:
        pass


class _Snapshot(StatefulProcessor):
    """What a new reader of a job needs: its status and its last rows, for every job with new events."""

    COLUMNS = ("kind", "progress", "stage", "message")
    _row = Row("task_id", "us", "seq", "message", "status", "progress", "stage", "error", "events")

    def __init__(self, size: int):
        self._size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._job = handle.getValueState("job", f"{HELD}, status string, stopping boolean, progress int, stage string, error string, events bigint")

    def handleInputRows(self, key, rows, timerValues):
        known = self._job.get()
        status, stopping, progress, stage, error, events = known[3:] if known else (PENDING, False, 0, "idle", None, 0)
        kept = _held(known)
        for _, us, seq, kind, new_progress, new_stage, message, *_ in _in_order(rows):
            before, events = status, events + 1
            if kind == "progress" and status == RUNNING:
                progress, stage = max(progress, min(99, int(new_progress))), new_stage
            status, stopping = next_status(status, stopping, kind)
            if before == RUNNING and status == COMPLETED:
                progress, stage = 100, "done"
            if before == RUNNING and status == FAILED:
                error = message
            kept.append((us, seq, message))
        kept = sorted(kept, key=lambda r: (r[0], r[1]))[-self._size :]
        self._job.update((*_arrays(kept), status, stopping, progress, stage, error, events))
        yield self._row(key[0], *_arrays(kept), status, progress, stage, error, events)

    def close(self) -> None:
        pass


class _OpenSegment(StatefulProcessor):
    """Numbers segments of a live series: a new one on a gap, or after ``cap`` rows.

    Rows wait until the watermark has passed them, so late ones still find their place; of what is behind it only the
    last time and the open segment are kept.
    """

    COLUMNS = ("value",)
    _row = Row("task_id", "us", "seq", "value", "seg_id", "row_in_seg")

    def __init__(self, gap_us: int, cap: int):
        self._gap, self._cap = gap_us, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._series = handle.getValueState(
            "series", "us array<bigint>, seq array<bigint>, value array<double>, timer bigint, last bigint, segment bigint, row int"
        )

    def _timer(self, waiting: list[tuple], timer: int | None) -> int | None:
        """Wake up when the watermark passes the first waiting row."""
        due = min(r[0] for r in waiting) // 1000 + 1 if waiting else None
        if due != timer:
            if timer is not None:
                self._handle.deleteTimer(timer)
            if due is not None:
                self._handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows, timerValues):
        known = self._series.get()
        waiting = _held(known) + [(r[1], r[2], float(r[3])) for r in rows]
        timer, opened = (known[3], known[4:]) if known else (None, (None, -1, 0))
        self._series.update((*_arrays(waiting), self._timer(waiting, timer), *opened))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        known = self._series.get()
        waiting = sorted(_held(known))
        ready, later = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        last, segment, row = known[4:]
        out = []
        for us, seq, value in ready:
            fresh = last is None or us - last >= self._gap or row + 1 >= self._cap
            segment, row = (segment + 1, 0) if fresh else (segment, row + 1)
            last = us
            out.append((us, seq, value, segment, row))
        # the timer that woke this up is spent
        self._series.update((*_arrays(later), self._timer(later, None), last, segment, row))
        if out:
            yield self._row(key[0], *_arrays(out, 5))

    def close(self) -> None:
        pass


def _apply(events: DataFrame, processor: StatefulProcessor, schema: str, mode: str, delay: str | None = None) -> DataFrame:
    """Run ``processor`` on rows ``(task_id, us, seq, its COLUMNS)``; times go in and out as microseconds.

    The rows of a key may come out as one row of arrays, which ``_unpacked`` takes apart.  With ``delay`` there are timers in event time.
    """
    wanted = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in processor.COLUMNS]
    rows = events if delay is None else events.withWatermark("ts", delay)
    # the operator finds the watermark by its column
    rows = rows.select("task_id", F.unix_micros("ts").alias("us"), "seq", *wanted, *([] if delay is None else ["ts"]))
    return rows.groupBy("task_id").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode=mode, timeMode="None" if delay is None else "EventTime"
    )


def _unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """A row for each place of the arrays ``us`` and ``columns``."""
    out = rows.select("task_id", F.inline(F.arrays_zip("us", *columns)))
    return out.select("task_id", F.timestamp_micros("us").alias("ts"), *columns)


def job_lifecycle(events: DataFrame) -> DataFrame:
    """State changes of jobs from ``(task_id, ts, seq, kind, progress, stage, message)``."""
    out = _apply(events, _Lifecycle(), LIFECYCLE_SCHEMA.replace("ts timestamp", "us bigint"), "Append")
    return out.select("task_id", "status", "progress", "stage", "error", F.timestamp_micros("us").alias("ts"))


def monotone_progress(events: DataFrame) -> DataFrame:
    """Progress per key that never goes back."""
    return _apply(events, _Progress(), "task_id string, progress int", "Update")


def backlog(events: DataFrame, size: int = BACKLOG) -> DataFrame:
    """The last ``size`` events of each key that got new ones."""
    return _unpacked(_apply(events, _Backlog(size), f"task_id string, {HELD}", "Update"), "seq", "message")


def silence_timeouts(events: DataFrame, seconds: int = TIMEOUT_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """A row for every time a key is without events for ``seconds`` of event time: a session that has ended."""
    sessions = events.withWatermark("ts", delay).groupBy("task_id", F.session_window("ts", f"{seconds} seconds"))
    return sessions.agg(F.max("ts").alias("last")).select("task_id", "last", F.lit("timed_out").alias("status"))


def hold_back(events: DataFrame, size: int, seconds: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Events in order, each after ``size`` later ones of its key; a row of kind ``end`` releases what is held.

    ``seconds`` of silence of a key in event time release it too; without it no timer is set.
    """
    out = _apply(events, _HoldBack(size, seconds), f"task_id string, {HELD}", "Append", None if seconds is None else delay)
    return _unpacked(out, "seq", "message")


def live_segments(events: DataFrame, gap_seconds: float, cap: int, delay: str = "0 seconds") -> DataFrame:
    """Segments of live series ``(task_id, ts, seq, value)``, as ``gap_or_cap_segments`` numbers those of a table.

    Adds ``seg_id`` and ``row_in_seg``; a row comes out once the watermark has passed it.
    """
    schema = "task_id string, us array<bigint>, seq array<bigint>, value array<double>, seg_id array<bigint>, row_in_seg array<int>"
    out = _apply(events, _OpenSegment(round(gap_seconds * 1_000_000), cap), schema, "Append", delay)
    return _unpacked(out, "seq", "value", "seg_id", "row_in_seg")


SNAPSHOT_SCHEMA = "task_id string, ts timestamp, seq bigint, message string, part string, status string, progress int, stage string, error string, events bigint"


def snapshots(events: DataFrame, size: int = BACKLOG) -> DataFrame:
    """Status and last ``size`` rows of each job that got new events, as rows of two kinds (``part``)."""
    job = {"status": "string", "progress": "int", "stage": "string", "error": "string", "events": "bigint"}
    jobs = _apply(events, _Snapshot(size), f"task_id string, {HELD}, " + ", ".join(f"{c} {t}" for c, t in job.items()), "Update")

    def line(us: Column, seq: Column, message: Column, part: str, of: list[Column]) -> Column:
        return F.struct(F.timestamp_micros(us).alias("ts"), seq.alias("seq"), message.alias("message"), F.lit(part).alias("part"), *of)

    empty = [F.lit(None).cast(t).alias(c) for c, t in job.items()]
    rows = F.transform(F.arrays_zip("us", "seq", "message"), lambda r: line(r["us"], r["seq"], r["message"], "row", empty))
    status = line(F.element_at("us", -1), F.element_at("seq", -1), F.lit(None).cast("string"), "status", [F.col(c) for c in job])
    return jobs.select("task_id", F.inline(F.concat(rows, F.array(status))))


def publish_snapshots(events: DataFrame, folder: str, checkpoint: str, size: int = BACKLOG) -> StreamingQuery:
    """Keep ``folder`` so that ``read_snapshot`` gives every job's status and last rows after the last whole batch.

    A batch writes the jobs it changed, both kinds of rows in one table of its own number, and marks itself whole as
    its last step.  A batch that is repeated after a restart replaces what it had written, and one that was cut off is
    not seen.
    """

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows/batch={number}")
        df.sparkSession.range(1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/whole/batch={number}")

    made = snapshots(events, size).writeStream.foreachBatch(write).outputMode("update")
    return made.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Status and last rows of every job: ``(task_id, status, progress, stage, error, events)``, ``(task_id, ts, seq, message)``."""
    whole = spark.read.parquet(f"{folder}/whole").select("batch").distinct()
    rows = spark.read.schema(f"{SNAPSHOT_SCHEMA}, batch bigint").parquet(f"{folder}/rows").join(whole, "batch", "left_semi")
    newest = rows.groupBy("task_id").agg(F.max("batch").alias("batch"))
    rows = rows.join(newest, ["task_id", "batch"])
    status = rows.filter("part = 'status'").select("task_id", "status", "progress", "stage", "error", "events")
    return status, rows.filter("part = 'row'").select("task_id", "ts", "seq", "message")
