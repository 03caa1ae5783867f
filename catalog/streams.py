"""Streaming queries: the events are fed as a file stream in time order and run to the end."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import EVENTS, HOUR, query, table
from catalog.events import SEGMENT_COLUMNS
from catalog.events import _segments as segments_cte
from tidemark.session import checkpoint_dir
from tidemark.sources.files import content_key
from tidemark.streaming import ingest, state, windows

SLICES = 4
# rows of a file; a slice of a larger table is several files, written and read side by side
ROWS_PER_FILE = 500_000
# user of the rows that close a stream, and how long after the last event they come
CLOSING, AFTER = -1, ("400 days", "401 days")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FEED = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _feed(spark: SparkSession, folder: str, stop_after: int | None = None) -> tuple[DataFrame, str]:
    """The events table as a stream of one batch per slice, and a shared folder for its checkpoint and result.

    Every slice has the same number of files, as that many make a batch.

    Two late rows at the end move the watermark, so that all windows of the table are closed, and one row of type
    ``end`` per user tells that no more will come.  With ``stop_after`` the slices from that number on wait aside until
    ``_resume``.
    """
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    ts = F.expr("timestampadd(MICROSECOND, timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts), timestamp'1970-01-01 00:00:00+00:00')")
    rows = table(spark, folder, "events").withColumn("ts", ts)
    # written slice by slice, as a file stream reads files in the order they were written
    us = F.unix_micros("ts")
    low, high, count = rows.agg(F.min(us), F.max(us), F.count(F.lit(1))).first()
    files = max(1, -(-count // (SLICES * ROWS_PER_FILE)))
    place = F.least(F.lit(SLICES - 1), F.floor((us - low) * SLICES / (high - low + 1)))
    names = rows.columns

    def slice_of(k: int) -> str:
        return f"{base}/{'feed' if stop_after is None or k < stop_after else 'later'}/slice={k}"

    def closing(at: Column) -> DataFrame:
        """A row for each file of a slice, of the user whose rows close the stream."""
        one = spark.range(files).select(F.col("id").cast("int").alias("_file"), at.alias("ts"), F.lit(CLOSING).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("close").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props"))
        return one.select(*names, "_file")

    def put(k: int, part: DataFrame) -> None:
        if files == 1:
            part.select(*names).coalesce(1).write.parquet(slice_of(k))
            return
        # a file without rows would not be written, so each has a row that closes
        dealt = part.select(*names, F.pmod(F.xxhash64("user_id", "event_id"), F.lit(files)).cast("int").alias("_file"))
        dealt.unionByName(closing(start)).repartitionById(files, "_file").select(*names).write.parquet(slice_of(k))

    start = F.timestamp_micros(F.lit(low))
    for k in range(SLICES):
        put(k, rows.filter(place == k))
    ends = rows.groupBy("user_id").agg(F.max("ts").alias("ts")).withColumns({"event_id": F.lit(-1).cast("bigint"), "event_type": F.lit("end"), "value": F.lit(0.0), "props": F.lit("")})
    put(SLICES, ends)
    for k, after in enumerate(AFTER):
        late = closing(F.timestamp_micros(F.lit(high)) + F.expr(f"interval {after}"))
        late.repartitionById(files, "_file").select(*names).write.parquet(slice_of(SLICES + 1 + k))
    return _stream(spark, base, files), base


def _stream(spark: SparkSession, base: str, files: int) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files).parquet(f"{base}/feed/slice=*")


def _resume(spark: SparkSession, base: str) -> DataFrame:
    """The stream once more, with the slices that waited."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(SLICES + 1 + len(AFTER)):
        if store.exists(path(f"{base}/later/slice={k}")):
            store.rename(path(f"{base}/later/slice={k}"), path(f"{base}/feed/slice={k}"))
    files = len(spark.read.parquet(f"{base}/feed/slice=0").inputFiles())
    return _stream(spark, base, files)


def _events_only(stream: DataFrame) -> DataFrame:
    """Without the rows that end a user; those that move the watermark stay."""
    return stream.filter("event_type != 'end'")


def _finish(result: DataFrame, base: str, mode: str) -> DataFrame:
    """Run a stream to its end; every batch goes to its own folder, so a repeated one replaces itself."""
    spark = result.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


def _as_jobs(stream: DataFrame) -> DataFrame:
    return stream.select(
        F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "end", "end").otherwise("log").alias("kind"),
        F.floor(F.col("value") / 5).cast("int").alias("progress"), F.lit("").alias("stage"), F.col("event_type").alias("message"),
    )


@query(f"""WITH {EVENTS}, x AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) <= {12 * HOUR} THEN 0 ELSE 1 END AS new FROM ev),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS k FROM x)
SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n, round(sqrt(avg(value * value)), 6) AS energy FROM s GROUP BY user_id, k""")
def stream_sessions(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(windows.gap_sessions(_events_only(stream), ["user_id"], "ts", "value", "12 hours", "10 days"), base, "append").filter(F.col("user_id") != CLOSING)
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n", F.round("energy", 6).alias("energy"))


@query(f"""WITH {EVENTS}, x AS (SELECT user_id, value, unnest([us // {3 * HOUR} * {3 * HOUR}, us // {3 * HOUR} * {3 * HOUR} - {3 * HOUR}]) AS window_us FROM ev)
SELECT user_id, window_us, count(*) AS n, round(sqrt(avg(value * value)), 6) AS rms FROM x GROUP BY 1, 2""")
def stream_rms(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(windows.hopping_energy(_events_only(stream), ["user_id"], "ts", "value", "6 hours", "3 hours", "10 days"), base, "append").filter(F.col("user_id") != CLOSING)
    return out.select("user_id", F.unix_micros("window_start").alias("window_us"), "n", F.round("rms", 6).alias("rms"))


@query(f"""WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(least(99, max(CAST(floor(value / 5) AS INTEGER))) AS INTEGER) AS progress FROM ev GROUP BY 1""")
def stream_monotone_max(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(state.monotone_progress(_as_jobs(_events_only(stream))), base, "update").filter(F.col("task_id") != str(CLOSING))
    return out.groupBy("task_id").agg(F.max("progress").alias("progress"))


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM ev) SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq FROM r""")
def stream_hold_back(spark, folder):
    stream, base = _feed(spark, folder)
    return _finish(state.hold_back(_as_jobs(stream), 3), base, "append").filter(F.col("task_id") != str(CLOSING)).select("task_id", "seq")


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS k FROM ev) SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, event_type AS message FROM r WHERE k <= 20""")
def stream_last_n(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(state.backlog(_as_jobs(_events_only(stream)), 20), base, "update").filter(F.col("task_id") != str(CLOSING))
    newest = out.groupBy("task_id").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["task_id", "batch"]).select("task_id", "seq", "message")


@query(f"""WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, event_type AS message FROM ev""")
def stream_hold_back_timer(spark, folder):
    """No row tells the end here: the last rows of a user come when the user has been silent for two days."""
    stream, base = _feed(spark, folder)
    out = _finish(state.hold_back(_as_jobs(_events_only(stream)), 3, 2 * 86_400), base, "append")
    return out.filter(F.col("task_id") != str(CLOSING)).select("task_id", "seq", "message")


@query(f"""WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS task_id, max(us) AS last_us, 'timed_out' AS status FROM ev GROUP BY 1""")
def stream_silence(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(state.silence_timeouts(_as_jobs(_events_only(stream)), 2 * 86_400), base, "append")
    out = out.filter(F.col("task_id") != str(CLOSING))
    # a user who comes back after a silence is reported again; the last report is the end
    return out.groupBy("task_id").agg(F.max(F.unix_micros("last")).alias("last_us"), F.first("status").alias("status"))


KINDS = {"signup": "start", "purchase": "done", "error": "error"}


def _as_lifecycle(stream: DataFrame) -> DataFrame:
    """A user's first signup starts a job, a purchase or an error ends it."""
    kind = F.coalesce(*[F.when(F.col("message") == m, k) for m, k in KINDS.items()], F.lit("progress"))
    return _as_jobs(_events_only(stream)).withColumn("kind", kind)


#: Place of the start and of the first end after it decide the status; only what lies between counts as progress.
LIFE = f"""{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM ev),
  s AS (SELECT user_id, min(k) FILTER (event_type = 'signup') AS s, count(*) AS n FROM r GROUP BY 1),
  e AS (SELECT user_id, min(k) FILTER (event_type IN ('purchase', 'error') AND k > s) AS e FROM r JOIN s USING (user_id) GROUP BY 1),
  p AS (SELECT user_id, max(least(99, CAST(floor(value / 5) AS INTEGER))) AS p FROM r JOIN s USING (user_id) JOIN e USING (user_id) WHERE k > s AND k < coalesce(e, n + 1) AND event_type NOT IN ('signup', 'purchase', 'error') GROUP BY 1),
  l AS (SELECT s.user_id, n, s, e.e, coalesce(p, 0) AS p, r.event_type FROM s JOIN e USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN r ON r.user_id = s.user_id AND r.k = e.e),
  st AS (SELECT user_id, n, p, CASE WHEN s IS NULL THEN 'pending' WHEN e IS NULL THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status FROM l)"""


@query(f"""WITH {LIFE}, b AS (SELECT user_id, count(*) AS held, min(event_id) AS least_seq, max(event_id) AS most_seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS d FROM ev) WHERE d <= 20 GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS task_id, status, CASE WHEN status = 'completed' THEN 100 ELSE p END::INTEGER AS progress, n AS events, held, least_seq, most_seq FROM st JOIN b USING (user_id)""")
def stream_snapshot(spark, folder):
    """Status and last rows of every job after the stream was stopped half way and started again."""
    stream, base = _feed(spark, folder, stop_after=2)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for more in (False, True):
        stream = _resume(spark, base) if more else stream
        state.publish_snapshots(_as_lifecycle(stream), f"{base}/out", f"{base}/state", 20).awaitTermination()
    status, rows = state.read_snapshot(spark, f"{base}/out")
    held = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("held"), F.min("seq").alias("least_seq"), F.max("seq").alias("most_seq"))
    return status.join(held, "task_id").filter(F.col("task_id") != str(CLOSING)).select("task_id", "status", "progress", "events", "held", "least_seq", "most_seq")


@query(f"""WITH {LIFE} SELECT CAST(user_id AS VARCHAR) AS task_id, status FROM st WHERE status <> 'pending'""")
def stream_lifecycle(spark, folder):
    stream, base = _feed(spark, folder)
    out = _finish(state.job_lifecycle(_as_lifecycle(stream)), base, "append").filter(F.col("task_id") != str(CLOSING))
    # changes of one time count in the order of the states
    rank = F.when(F.col("status") == "running", 0).otherwise(1)
    return out.groupBy("task_id").agg(F.max_by("status", F.struct(rank, "ts")).alias("status"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '[\r\n]')) AS line FROM documents), t AS (SELECT doc_id, trim(line, ' ') AS line FROM l)
SELECT doc_id, level, "lines", CASE WHEN top IS NOT NULL THEN least(100, top) END AS top_percent FROM (SELECT doc_id, CASE WHEN contains(lower(line), 'ready') OR contains(lower(line), 'already') THEN 'success' WHEN contains(lower(line), 'failed') OR contains(lower(line), 'error') THEN 'error' ELSE 'info' END AS level,
  count(*) AS "lines", max(CAST(nullif(regexp_extract(line, '\b(\d{1,3})%\b', 1), '') AS INTEGER)) AS top FROM t WHERE line <> '' GROUP BY 1, 2)""")
def stream_log_lines(spark, folder):
    """Lines of all documents as a stream, classified as they come."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    # the pattern takes the table for a folder of files, whether it is one file or several
    stream = spark.readStream.schema("doc_id bigint, text string").parquet(f"{folder}/documents.parque[t]")
    lines = _finish(windows.log_lines(stream, "text"), base, "append")
    return lines.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("lines"), F.max("percent").alias("top_percent"))


@query(f"WITH {segments_cte(12 * HOUR, 48)} SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(seg_id AS BIGINT) AS seg_id, {SEGMENT_COLUMNS} FROM s GROUP BY ALL")
def stream_segments(spark, folder):
    """Segments by gap and cap of live series, equal to those of the whole table."""
    stream, base = _feed(spark, folder)
    rows = _events_only(stream).select(F.col("user_id").cast("string").alias("task_id"), "ts", F.col("event_id").alias("seq"), "value")
    out = _finish(state.live_segments(rows, 12 * 3600, 48), base, "append").filter(F.col("task_id") != str(CLOSING))
    us, v = F.unix_micros("ts"), F.col("value")
    return out.groupBy("task_id", "seg_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("start_us"), F.max(us).alias("end_us"), F.round(F.sqrt(F.avg(v * v)), 6).alias("energy")
    )


@query("""SELECT md5(text) AS md5, min(CAST(doc_id AS VARCHAR)) AS path, min(CAST(doc_id AS VARCHAR)) || '_' || substr(md5(text), 1, 8) AS output_key FROM documents GROUP BY md5(text)""")
def stream_ingest(spark, folder):
    """Documents as incoming files, each content once; a second stream with a state of its own finds nothing new."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    texts = spark.readStream.schema("doc_id bigint, text string").parquet(f"{folder}/documents.parque[t]")
    key = content_key(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    files = texts.select(F.col("doc_id").cast("string").alias("path"), key["md5"].alias("md5"), key["output_key"].alias("output_key"))
    for run in range(2):
        ingest.ingest_new(files, lambda df: df.select("md5", "path", "output_key"), f"{base}/manifest", f"{base}/rows", f"{base}/check-{run}").awaitTermination()
    return spark.read.schema("md5 string, path string, output_key string").parquet(f"{base}/rows").select("md5", "path", "output_key")
