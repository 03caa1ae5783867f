"""Queries over the event series: islands, windows and snapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import EVENTS, HOUR, NOTES, events, notes, query
from tidemark.functions import arrays as A
from tidemark.functions import grid as G
from tidemark.operators import evaluate as E
from tidemark.operators import islands as I
from tidemark.operators import segments as S
from tidemark.operators import series as R
from tidemark.operators import snap as P
from tidemark.plans.consensus import rebuild_increasing
from tidemark.scan import Scan, with_blocks

U = ["user_id"]
O = ["us", "event_id"]


def _segments(gap: int, cap: int) -> str:
    return f"""{EVENTS},
  g AS (SELECT *, us - lag(us) OVER w AS d, row_number() OVER w AS rn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  b AS (SELECT *, max(CASE WHEN d IS NULL OR d >= {gap} THEN rn END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS f FROM g),
  r AS (SELECT *, (rn - f) % {cap} AS row_in_seg FROM b),
  s AS (SELECT *, sum(CASE WHEN row_in_seg = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS seg_id FROM r)"""


def segmented(spark, folder, gap=12 * HOUR, cap=48):
    return I.gap_or_cap_segments(events(spark, folder), U, "us", "us", O, gap, cap)


SEGMENT_COLUMNS = """CAST(count(*) AS BIGINT) AS n, min(us) AS start_us, max(us) AS end_us,
  round(sqrt(avg(value * value)), 6) AS energy"""


def _per_segment(rows):
    v = F.col("value")
    return rows.groupBy("user_id", "seg_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"),
        F.round(F.sqrt(F.avg(v * v)), 6).alias("energy"),
    )


@query(f"WITH {_segments(12 * HOUR, 48)} SELECT user_id, CAST(seg_id AS BIGINT) AS seg_id, {SEGMENT_COLUMNS} FROM s GROUP BY ALL")
def segment_gap_or_cap(spark, folder):
    return _per_segment(segmented(spark, folder))


@query(f"WITH {_segments(24 * HOUR, 8)} SELECT user_id, CAST(seg_id AS BIGINT) AS seg_id, {SEGMENT_COLUMNS} FROM s GROUP BY ALL")
def segment_gap_or_cap_short(spark, folder):
    return _per_segment(segmented(spark, folder, 24 * HOUR, 8))


@query(f"""WITH {_segments(12 * HOUR, 48)}, x AS (SELECT user_id, seg_id, (max(us) - min(us)) / 3600000000.0::DOUBLE AS d FROM s GROUP BY ALL)
SELECT user_id, count(*) AS segments, round(min(d), 6) AS min_len, round(max(d), 6) AS max_len, round(avg(d), 6) AS avg_len FROM x GROUP BY user_id""")
def segment_stats(spark, folder):
    s = segmented(spark, folder).groupBy("user_id", "seg_id").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    out = S.length_statistics(s, U, float(HOUR))
    return out.select("user_id", "segments", *[F.round(c, 6).alias(c) for c in ("min_len", "max_len", "avg_len")])


@query(f"""WITH {EVENTS} SELECT user_id, event_id, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id), 0) AS gap FROM ev""")
def previous_gap(spark, folder):
    return I.previous_gap(events(spark, folder), U, "us", "us", O).select("user_id", "event_id", "gap")


@query(f"""WITH {_segments(12 * HOUR, 48)}, x AS (SELECT user_id, seg_id, min(us) AS a, max(us) AS b FROM s GROUP BY ALL),
  k AS (SELECT *, greatest(1, sum(CASE WHEN b - a >= {2 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b)) AS k FROM x)
SELECT user_id, CAST(k - 1 AS BIGINT) AS seg_id, min(a) AS "start", max(b) AS "end", count(*) AS parts FROM k GROUP BY user_id, k""")
def merge_tiny_segments(spark, folder):
    s = segmented(spark, folder).groupBy("user_id", "seg_id").agg(F.min("us").alias("start"), F.max("us").alias("end"))
    return I.merge_tiny(s.drop("seg_id"), U, "start", "end", 2 * HOUR).select("user_id", "seg_id", "start", "end", "parts")


@query(f"""WITH {EVENTS}, x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS p FROM ev)
SELECT user_id, event_id, event_type FROM x WHERE (p IS NULL OR p <> event_type) AND event_type <> 'view'""")
def collapse_repeats(spark, folder):
    return I.collapse_repeats(events(spark, folder), U, O, "event_type", "view").select("user_id", "event_id", "event_type")


@query(f"""WITH {EVENTS}, x AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS run FROM x)
SELECT user_id, CAST(run AS BIGINT) AS run_id, min(event_type) AS event_type, round(sum(value), 6) AS value, count(*) AS "rows" FROM r GROUP BY user_id, run""")
def run_lengths(spark, folder):
    out = I.merge_equal_flags(events(spark, folder), U, O, "event_type", "value")
    return out.withColumn("value", F.round("value", 6))


def indexed(spark, folder):
    """Events numbered from 0 per user."""
    rows = with_blocks(events(spark, folder), U, "us")
    return Scan(rows, U, O).row_number("_n").columns().select(
        "user_id", "event_id", "event_type", "value", "us", (F.col("_n") - 1).alias("idx")
    )


INDEXED = f"{EVENTS}, ix AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS idx FROM ev)"


@query(f"""WITH {INDEXED}, n AS (SELECT user_id, max(idx) AS last FROM ix GROUP BY 1),
  a AS (SELECT user_id, idx, CASE WHEN idx - lag(idx) OVER (PARTITION BY user_id ORDER BY idx) <= 6 THEN 0 ELSE 1 END AS new FROM ix WHERE value >= 60),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY idx) AS run FROM a),
  g AS (SELECT user_id, run, min(idx) AS f, max(idx) AS e FROM r GROUP BY 1, 2),
  x AS (SELECT g.*, n.last, n.last - g.e <= 5 AS o FROM g JOIN n USING (user_id))
SELECT user_id, f AS first, CASE WHEN o THEN last ELSE e END AS last FROM x
WHERE CASE WHEN o THEN last + 1 - f >= 10 ELSE e > f AND e - f >= 10 END""")
def threshold_runs_with_gap(spark, folder):
    return I.threshold_runs(indexed(spark, folder), U, "idx", "value", 60.0)


@query(f"""WITH {INDEXED}, x AS (SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM ix)
SELECT user_id, event_id, idx + 1 AS row_number, CAST(len(list_distinct(l)) AS INTEGER) AS distinct_values FROM x WHERE idx >= 15 AND len(list_distinct(l)) <= 3""")
def degenerate_repetition(spark, folder):
    return I.degenerate_rows(events(spark, folder), U, O, "event_type").select("user_id", "event_id", "row_number", "distinct_values")


SNAP_TICKS = f"""{NOTES},
  t AS (SELECT *, CAST(round_even("onset" * 120.0::DOUBLE * 8, 0) AS BIGINT) AS a, CAST(round_even("offset" * 120.0::DOUBLE * 8, 0) AS BIGINT) AS b,
    row_number() OVER (PARTITION BY user_id ORDER BY onset, event_id) AS i, lead(onset) OVER (PARTITION BY user_id ORDER BY onset, event_id) AS nxt FROM nt)"""


@query(f"""WITH {SNAP_TICKS},
  q AS (SELECT *, max(CAST(round_even(a / 60.0::DOUBLE, 0) * 60 AS BIGINT) - i * 60) OVER (PARTITION BY user_id ORDER BY i) + i * 60 AS s FROM t),
  z AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY i) AS ns FROM q),
  e AS (SELECT *, CASE WHEN abs("offset" - nxt) < 1e-3 THEN ns ELSE CAST(round_even(b / 60.0::DOUBLE, 0) * 60 AS BIGINT) END AS e0 FROM z),
  f AS (SELECT *, CASE WHEN e0 <= s THEN s + 60 ELSE e0 END AS e1 FROM e)
SELECT user_id, event_id, round(s / 960.0::DOUBLE, 6) AS onset, round(least(e1, coalesce(ns, e1)) / 960.0::DOUBLE, 6) AS "offset" FROM f""")
def snap_simple_grid(spark, folder):
    out = P.snap_simple(notes(spark, folder), U, ["event_id"], 120.0, 60)
    return out.select("user_id", "event_id", F.round("onset", 6).alias("onset"), F.round("offset", 6).alias("offset"))


def _snapped(mode):
    def run(spark, folder):
        out = P.snap_timeline(notes(spark, folder), U, ["event_id"], 120.0, 60, mode)
        return out.select("user_id", "event_id", F.round("onset", 6).alias("onset"), F.round("offset", 6).alias("offset"))

    return run


query(name="snap_smart")(_snapped("smart"))
query(name="snap_phrase")(_snapped("dp"))
query(name="snap_prior")(_snapped("bayes"))


@query(f"""WITH {SNAP_TICKS},
  m AS (SELECT *, i + greatest(0, max(greatest(b, a + 1) - i) OVER (PARTITION BY user_id ORDER BY i)) AS e FROM t),
  p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY i), 0) AS before FROM m)
SELECT user_id, event_id, 'on' AS kind, greatest(a, before) AS tick, greatest(a, before) - before AS delta FROM p
UNION ALL SELECT user_id, event_id, 'off', e, e - greatest(a, before) FROM p""")
def event_stream_clamp(spark, folder):
    n = notes(spark, folder).select("user_id", "event_id", "onset", G.ticks("onset", 120.0).alias("a"), G.ticks("offset", 120.0).alias("b"))
    return R.event_rows(n, U, ["onset", "event_id"], "a", "b").select("user_id", "event_id", "kind", "tick", "delta")


@query(f"""WITH {SNAP_TICKS}, s AS (SELECT *, CAST(round_even(a / 60.0::DOUBLE, 0) * 60 - a AS DOUBLE) AS sh, CAST(((a % 60) + 60) % 60 AS DOUBLE) AS ph, CAST(floor((i - 1) / 12) AS BIGINT) AS batch FROM t),
  m AS (SELECT user_id, batch, count(*) AS n, median(sh) AS ms, median(ph) AS mp FROM s GROUP BY 1, 2),
  d AS (SELECT m.user_id, m.batch, any_value(n) AS n, any_value(ms) AS ms, any_value(mp) AS mp, avg(abs(sh - ms)) AS sp, avg(abs(ph - mp)) AS pp FROM s JOIN m USING (user_id, batch) GROUP BY 1, 2)
SELECT user_id, batch, CASE WHEN n >= 4 AND mp >= 30 AND pp <= 30 THEN -mp ELSE ms END AS centre,
  round(CASE WHEN n >= 4 AND mp >= 30 AND pp <= 30 THEN 0.08 * greatest(greatest(0, 1 - least(sp / 24, 1)), greatest(0, 1 - least(pp / 21, 1))) ELSE 0.03 * greatest(0, 1 - least(sp / 24, 1)) END, 6) AS weight FROM d""")
def phase_centre(spark, folder):
    n = notes(spark, folder).withColumn("a", G.ticks("onset", 120.0))
    n = I.number_batches(n, U, ["onset", "event_id"], 12)
    return P.phase_centre(n, ["user_id", "batch"], "a", 60).withColumn("weight", F.round("weight", 6))


LENGTHS = "[60, 120, 180, 240, 360, 480, 720, 960, 1440, 1920]"
GAPS = "[0, 60, 120, 180, 240, 360, 480]"


@query(f"""WITH {SNAP_TICKS}, x AS (SELECT user_id, a, greatest(b, a + 1) - a AS len, lyric = '-' AS tie,
    coalesce(greatest(0, a - lag(greatest(b, a + 1)) OVER (PARTITION BY user_id ORDER BY i)), 0) AS gap FROM t),
  w AS (SELECT user_id, max(len) AS longest, max(gap) AS widest FROM x GROUP BY 1),
  g AS (SELECT user_id, greatest(1, CAST(round_even(len / 60.0::DOUBLE, 0) AS BIGINT)) AS length_multiple, CAST(round_even(gap / 60.0::DOUBLE, 0) AS BIGINT) AS gap_multiple, tie,
    count(*) AS n, median(len) AS ml, median(gap) AS mg, median(((a % 480) + 480) % 480) AS mp FROM x GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3),
  c AS (SELECT g.*, list_filter({LENGTHS}, lambda v: v <= greatest(60, ceil(longest / 60.0) * 60 + 120)) AS ls, list_filter({GAPS}, lambda v: v <= greatest(120, ceil(widest / 60.0) * 60 + 60)) AS gs FROM g JOIN w USING (user_id))
SELECT user_id, length_multiple, gap_multiple, tie, n, round(least(0.65, 0.18 + 0.12 * (n - 3)), 6)::DOUBLE AS strength,
  CAST(list_min(list_transform(ls, lambda v: {{'d': abs(v - ml), 'v': v}})).v AS BIGINT) AS preferred_length,
  CAST(list_min(list_transform(gs, lambda v: {{'d': abs(v - mg), 'v': v}})).v AS BIGINT) AS preferred_gap,
  CAST(list_min(list_transform([0, 60, 120, 180, 240, 300, 360, 420], lambda v: {{'d': abs(v - mp), 'v': v}})).v AS BIGINT) AS preferred_phase FROM c""")
def frequent_pattern(spark, folder):
    n = notes(spark, folder).select(
        "user_id", "event_id", "onset", G.ticks("onset", 120.0).alias("a"), G.ticks("offset", 120.0).alias("b"), (F.col("lyric") == "-").alias("tie")
    )
    n = n.withColumn("b", F.greatest("b", F.col("a") + 1))
    n = I.previous_gap(n, U, "a", "b", ["onset", "event_id"]).withColumn("len", F.col("b") - F.col("a"))
    return P.frequent_patterns(n, U, "a", "len", "gap", "tie", 60, at_least=3).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {NOTES}, x AS (SELECT event_id, CAST(round_even(onset * 960, 0) AS BIGINT) AS a, CAST(round_even("offset" * 960, 0) AS BIGINT) - CAST(round_even(onset * 960, 0) AS BIGINT) AS d FROM nt)
SELECT event_id, least(a % 60, 60 - a % 60) AS grid, least(abs(a - 100) % 480, 480 - abs(a - 100) % 480) AS circular,
  round(CASE WHEN a % 480 = 0 THEN 0 WHEN a % 240 = 0 THEN 2.4 WHEN a % 120 = 0 THEN 6 WHEN a % 60 = 0 THEN 12 ELSE 25.2 END, 6)::DOUBLE AS position_cost,
  round(CASE WHEN greatest(1, round_even(d / 60.0::DOUBLE, 0)) IN (1, 2, 4, 8, 16, 32) THEN 0 WHEN greatest(1, round_even(d / 60.0::DOUBLE, 0)) IN (3, 6, 12, 24) THEN 3 ELSE 9.6 END, 6)::DOUBLE AS length_cost,
  CAST(CASE WHEN d <= 22 THEN NULL WHEN d / 60.0 <= 1.5 THEN 60 WHEN d / 60.0 <= 2.625 THEN 120 WHEN d / 60.0 <= 3.375 THEN 180 WHEN d / 60.0 <= 4.625 THEN 240 WHEN d / 60.0 <= 5.625 THEN 300 WHEN d / 60.0 <= 7 THEN 360
    ELSE greatest(60, round_even(d / 60.0::DOUBLE, 0) * 60) END AS BIGINT) AS preferred,
  CAST(CASE WHEN d > 0 THEN d ELSE 0 END AS BIGINT) AS length FROM x""")
def grid_features(spark, folder):
    a, b = G.ticks("onset", 120.0), G.ticks("offset", 120.0)
    n = notes(spark, folder).select("event_id", a.alias("a"), (b - a).alias("d"))
    return n.select(
        "event_id", G.grid_distance("a", F.lit(60).cast("bigint")).alias("grid"),
        G.circular_distance("a", F.lit(100).cast("bigint"), F.lit(480).cast("bigint")).alias("circular"),
        F.round(G.position_penalty("a", 60), 6).alias("position_cost"), F.round(G.length_penalty("d", 60), 6).alias("length_cost"),
        G.preferred_length("d", 60).alias("preferred"), F.greatest(F.lit(0).cast("bigint"), F.col("d")).alias("length"),
    )


@query(f"""WITH {NOTES}, x AS (SELECT event_id, CAST(round_even(onset * 960, 0) AS BIGINT) AS a, CAST(round_even("offset" * 960, 0) AS BIGINT) AS b FROM nt),
  p AS (SELECT event_id, a, b, unnest(generate_series(-3, 3)) AS j FROM x),
  s AS (SELECT event_id, a, b, CAST((round_even(a / 60.0::DOUBLE, 0) + j) * 60 AS BIGINT) AS s FROM p),
  e AS (SELECT DISTINCT event_id, s, CAST((round_even(b / 60.0::DOUBLE, 0) + k) * 60 AS BIGINT) AS e FROM s, (SELECT unnest(generate_series(-3, 3)) AS k))
SELECT event_id, count(*) AS pairs, min(s) AS first_start, max(e) AS last_end, CAST(sum(e - s) AS BIGINT) AS total FROM e WHERE e > s GROUP BY event_id""")
def candidate_pairs(spark, folder):
    n = notes(spark, folder).select("event_id", G.ticks("onset", 120.0).alias("a"), G.ticks("offset", 120.0).alias("b"))
    pairs = n.select("event_id", F.explode(G.candidate_pairs("a", "b", 60)).alias("p"))
    return pairs.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("p.s").alias("first_start"), F.max("p.e").alias("last_end"), F.sum(F.col("p.e") - F.col("p.s")).alias("total")
    )


@query(f"""WITH {INDEXED}, x AS (SELECT *, list(value) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM ix)
SELECT user_id, event_id, list_sort(l)[len(l) // 2 + 1] AS smoothed FROM x""")
def moving_upper_median(spark, folder):
    return R.moving_upper_median(events(spark, folder), U, O, "value").select("user_id", "event_id", "smoothed")


@query(f"""WITH {INDEXED}, v AS (SELECT user_id, event_id, idx, CASE WHEN value < 80 THEN value END AS y FROM ix),
  w AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY user_id ORDER BY idx) AS pi,
    min(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM v)
SELECT w.user_id, w.event_id, round(CASE WHEN w.y IS NOT NULL THEN w.y WHEN p.y IS NULL THEN n.y WHEN n.y IS NULL THEN p.y
  ELSE p.y + (n.y - p.y) * ((w.idx - w.pi) / (w.ni - w.pi)::DOUBLE) END, 6) AS filled
FROM w LEFT JOIN v p ON p.user_id = w.user_id AND p.idx = w.pi LEFT JOIN v n ON n.user_id = w.user_id AND n.idx = w.ni""")
def interpolate_linear(spark, folder):
    rows = indexed(spark, folder).withColumn("y", F.when(F.col("value") < 80, F.col("value")))
    return R.interpolate_linear(rows, U, "idx", "y").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


HOURLY = f"""{EVENTS}, h AS (SELECT user_id, CAST(floor(us / {HOUR}) AS BIGINT) * 5 AS x, CAST(max(round_even(value, 0)) AS BIGINT) AS y FROM ev GROUP BY 1, 2)"""


@query(f"""WITH {HOURLY}, l AS (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS nx, lead(y) OVER (PARTITION BY user_id ORDER BY x) AS ny FROM h),
  m AS (SELECT *, CASE WHEN (nx - x) // 5 - 1 BETWEEN 1 AND 12 THEN (nx - x) // 5 - 1 ELSE 0 END AS k FROM l),
  e AS (SELECT *, unnest(generate_series(0, k)) AS j FROM m)
SELECT user_id, x + j * 5 AS x, CASE WHEN j = 0 THEN y ELSE CAST(round_even(y + (ny - y) * (j / (k + 1)::DOUBLE), 0) AS BIGINT) END AS y FROM e""")
def fill_short_gaps(spark, folder):
    h = events(spark, folder).groupBy("user_id", (F.floor(F.col("us") / HOUR) * 5).alias("x")).agg(F.max(F.rint("value")).cast("bigint").alias("y"))
    return R.fill_short_gaps(h, U, "x", "y")


@query(f"""WITH RECURSIVE {_segments(12 * HOUR, 48)},
  y AS (SELECT user_id, seg_id, us, event_id, CAST(round_even(value, 0) AS BIGINT) AS y, row_number() OVER (PARTITION BY user_id, seg_id ORDER BY us, event_id) AS k FROM s),
  p AS (SELECT *, lead(y) OVER (PARTITION BY user_id, seg_id ORDER BY k) AS n FROM y),
  f AS (SELECT *, CAST(y AS DOUBLE) AS v FROM p WHERE k = 1
    UNION ALL SELECT p.*, CASE WHEN abs(p.y - (f.v + p.n) / 2.0) > 75 THEN round_even(p.y - (p.y - (f.v + p.n) / 2.0) * 0.7, 0) ELSE CAST(p.y AS DOUBLE) END
    FROM f JOIN p ON p.user_id = f.user_id AND p.seg_id = f.seg_id AND p.k = f.k + 1)
SELECT user_id, CAST(seg_id AS BIGINT) AS seg_id, us, event_id, y, CAST(v AS BIGINT) AS smoothed FROM f""")
def despike(spark, folder):
    rows = segmented(spark, folder).withColumn("y", F.rint("value").cast("bigint"))
    return R.despike(rows.select("user_id", "seg_id", "us", "event_id", "y"), ["user_id", "seg_id"], O, "y")


@query(f"""WITH {EVENTS} SELECT user_id, round(exp(avg(ln(value / 500 + 1e-6)) / 3), 6) AS confidence FROM ev GROUP BY user_id""")
def geometric_confidence(spark, folder):
    return events(spark, folder).groupBy("user_id").agg(F.round(R.geometric_confidence(F.col("value") / 500), 6).alias("confidence"))


@query(f"""WITH {INDEXED}, c AS (SELECT user_id, idx // 16 AS chunk, list(value ORDER BY idx) AS l FROM ix GROUP BY 1, 2)
SELECT user_id, chunk, CAST(len(l) AS INTEGER) AS used, CAST(16 AS INTEGER) AS size, l[1] AS first_value, CASE WHEN len(l) = 16 THEN l[16] ELSE 0 END AS last_value, round(list_sum(l), 6) AS total FROM c""")
def fixed_chunks(spark, folder):
    c = R.padded_chunks(indexed(spark, folder), U, "idx", "value", 16)
    return c.select(
        "user_id", "chunk", "used", F.size("values").alias("size"), F.get("values", F.lit(0)).alias("first_value"),
        F.get("values", F.lit(15)).alias("last_value"), F.round(A.array_total("values"), 6).alias("total"),
    )


@query(f"""WITH {INDEXED}, m AS (SELECT user_id, median(value) AS md FROM ev GROUP BY 1)
SELECT user_id, round(any_value(md), 9) AS median, round(avg(abs(value - md)), 9) AS spread, round(greatest(0, 1 - least(avg(abs(value - md)) / 80, 1)), 9) AS strength
FROM ev JOIN m USING (user_id) GROUP BY user_id""")
def median_shift_strength(spark, folder):
    out = E.median_spread(events(spark, folder), U, "value", 80.0)
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in ("median", "spread", "strength")])


@query(f"""WITH {EVENTS}, m AS (SELECT event_type, median(value) AS md FROM ev GROUP BY 1), d AS (SELECT ev.event_type, value, md, abs(value - md) AS off FROM ev JOIN m USING (event_type)),
  a AS (SELECT event_type, median(off) AS mad FROM d GROUP BY 1), k AS (SELECT d.*, mad FROM d JOIN a USING (event_type))
SELECT event_type, round(coalesce(avg(value) FILTER (mad <> 0 AND off / (mad * 1.4826) <= 1.5), any_value(md)), 6) AS trimmed_mean, round(any_value(md), 6) AS median,
  count(*) FILTER (mad <> 0 AND off / (mad * 1.4826) <= 1.5) AS kept FROM k GROUP BY event_type""")
def mad_trimmed_mean(spark, folder):
    out = E.trimmed_mean(events(spark, folder), ["event_type"], "value")
    return out.select("event_type", F.round("trimmed_mean", 6).alias("trimmed_mean"), F.round("median", 6).alias("median"), "kept")


@query(f"""WITH {INDEXED} SELECT user_id, event_id, round(coalesce(lead(value) OVER w - value, 0), 6) AS edge_diff,
  round(least(1, greatest(0, value / 500 + coalesce(lag(value) OVER w / 500, 0))), 6) AS edge_prob FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY idx)""")
def edge_features(spark, folder):
    rows = indexed(spark, folder).withColumn("p", F.col("value") / 500)
    out = R.edge_features(rows, U, "idx", "p")
    return out.select("user_id", "event_id", F.round(F.col("edge_diff") * 500, 6).alias("edge_diff"), F.round("edge_prob", 6).alias("edge_prob"))


@query(f"""WITH {INDEXED} SELECT user_id, event_id, CAST(least(99, greatest(0, max(CAST(floor(value / 5) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY idx))) AS INTEGER) AS progress FROM ix""")
def monotone_progress(spark, folder):
    rows = events(spark, folder).withColumn("p", F.floor(F.col("value") / 5).cast("int"))
    return R.mono_progress(rows, U, O, "p").select("user_id", "event_id", "progress")


@query(f"""WITH {EVENTS} SELECT user_id, round(sum(value) / sum(value + 10), 6) AS rtf, round(sum(length(props)) / sum(value), 6) AS tokens_per_sec FROM ev GROUP BY 1""")
def throughput(spark, folder):
    rows = events(spark, folder).withColumn("audio", F.col("value") + 10).withColumn("tokens", F.length("props"))
    out = R.throughput(rows, U, "audio", "value", "tokens", "value")
    return out.select("user_id", F.round("rtf", 6).alias("rtf"), F.round("tokens_per_sec", 6).alias("tokens_per_sec"))


@query(f"""WITH {EVENTS}, x AS (SELECT user_id, event_id, us / {HOUR} AS a, us / {HOUR} + value / 50 AS b, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM ev),
  m AS (SELECT *, i * 0.5 + greatest(0, max(greatest(b, a + 0.5) - i * 0.5) OVER (PARTITION BY user_id ORDER BY i)) AS e FROM x)
SELECT user_id, event_id, round(greatest(a, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY i), 0)), 4) AS "start", round(e, 4) AS "end" FROM m""")
def rebuild_increasing_intervals(spark, folder):
    rows = events(spark, folder).withColumn("start", F.col("us") / HOUR)
    rows = rows.select("user_id", "event_id", "us", "start", (F.col("start") + F.col("value") / 50).alias("end"))
    out = rebuild_increasing(rows, U, "us", "start", "end", 0.5)
    return out.select("user_id", "event_id", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"""WITH RECURSIVE {NOTES}, o AS (SELECT *, row_number() OVER w AS rn, lag("offset") OVER w AS before FROM nt WINDOW w AS (PARTITION BY user_id ORDER BY onset, event_id)),
  x AS (SELECT *, before IS NULL OR abs(before - onset) >= 6.0 OR lyric <> '-' AS cut FROM o),
  r AS (SELECT user_id, rn, pitch AS base, rn AS g FROM x WHERE rn = 1
    UNION ALL SELECT x.user_id, x.rn, CASE WHEN cut OR NOT abs(base - pitch) < 8 THEN pitch ELSE base END, CASE WHEN cut OR NOT abs(base - pitch) < 8 THEN x.rn ELSE g END
    FROM r JOIN x ON x.user_id = r.user_id AND x.rn = r.rn + 1)
SELECT user_id, min(onset) AS onset, arg_max("offset", rn) AS "offset", arg_min(pitch, rn) AS pitch, arg_min(lyric, rn) AS lyric, count(*) AS "rows" FROM x JOIN r USING (user_id, rn) GROUP BY user_id, g""")
def anchored_runs(spark, folder):
    return I.anchored_runs(notes(spark, folder), U, "onset", "offset", "pitch", "lyric", ["onset", "event_id"], max_gap=6.0, tolerance=8.0)


@query(f"""WITH RECURSIVE {NOTES}, t AS (SELECT user_id, event_id, onset, lyric, CAST(round_even(onset * 120 * 480 / 60, 0) AS BIGINT) AS a, CAST(round_even("offset" * 120 * 480 / 60, 0) AS BIGINT) AS b FROM nt),
  o AS (SELECT *, row_number() OVER w AS rn, a - lag(b) OVER w AS gap, lag(lyric) OVER w AS before FROM t WINDOW w AS (PARTITION BY user_id ORDER BY onset, event_id)),
  r AS (SELECT user_id, rn, a, b, rn AS first, 0 AS seg_id FROM o WHERE rn = 1
    UNION ALL SELECT user_id, rn, a, b, CASE WHEN h THEN rn ELSE first END, CASE WHEN h THEN seg_id + 1 ELSE seg_id END FROM (
      SELECT o.user_id, o.rn, o.a, o.b, r.first, r.seg_id, o.gap >= 60 OR (o.gap > 0 AND o.before <> '-' AND o.lyric <> '-') OR (o.rn - r.first >= 16 AND o.gap >= 0) AS h
      FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT user_id, CAST(seg_id AS BIGINT) AS seg_id, count(*) AS n, min(a) AS start, max(b) AS "end" FROM r GROUP BY 1, 2""")
def tied_phrases(spark, folder):
    n = notes(spark, folder).withColumn("a", G.ticks("onset", 120.0)).withColumn("b", G.ticks("offset", 120.0))
    out = I.tied_phrases(n, U, "a", "b", "lyric", ["onset", "event_id"], 60)
    return out.groupBy("user_id", "seg_id").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("start"), F.max("b").alias("end"))


@query(f"""WITH {INDEXED} SELECT user_id, event_id, CAST(floor(idx / 8) AS BIGINT) AS batch FROM ix""")
def number_batches(spark, folder):
    return I.number_batches(events(spark, folder), U, O, 8).select("user_id", "event_id", "batch")


@query("""SELECT event_id, greatest(0.0, 0.02 * (event_id % 100 + least(0.5, greatest(-0.5, value / 1000 / 2)))) AS at, CAST(floor(floor(value / 7 * 16000) / 320) AS BIGINT) AS frame,
  CAST(least(60, greatest(10, round_even(value % 480 * 0.25, 0))) AS BIGINT) AS shift, list_transform(range(4), lambda i: round(value / 1000 + i * (1 - value / 1000) / 4, 9)) AS schedule FROM events""")
def frame_times(spark, folder):
    e = events(spark, folder)
    schedule = F.transform(G.time_schedule(F.col("value") / 1000, 4), lambda x: F.round(x, 9))
    return e.select(
        "event_id", G.frame_to_seconds(F.col("event_id") % 100, F.lit(0.02), F.col("value") / 1000).alias("at"),
        G.seconds_to_frame(F.col("value") / 7, F.lit(16000), F.lit(320)).alias("frame"), G.shift_limit(F.col("value") % 480, 0.25, 10, 60).alias("shift"), schedule.alias("schedule"),
    )


@query("""SELECT event_id, CAST(event_id % 120 AS DOUBLE) AS back, CASE WHEN value > 0 THEN round(69.0 + 12.0 * log2(value / 440.0), 6) END AS semitone FROM events""")
def note_inverse(spark, folder):
    from tidemark.functions import pitch as N

    e = events(spark, folder)
    return e.select("event_id", N.pitch_from_name(N.pitch_name((F.col("event_id") % 120).cast("double"))).alias("back"), F.round(N.semitone("value"), 6).alias("semitone"))


@query(f"""WITH {INDEXED}, d AS (SELECT user_id, us // {24 * HOUR} AS day, list(event_id ORDER BY idx) AS ids, list(value ORDER BY idx) AS vs, count(*) AS n FROM ix GROUP BY 1, 2),
  m AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS w FROM d)
SELECT user_id, CAST(day AS BIGINT) AS day, array_to_string(list_resize(ids, w, -1), ',') AS ids, round(list_sum(vs), 6) AS total, CAST(w AS INTEGER) AS width, CAST(n AS INTEGER) AS length, CAST(n AS BIGINT) AS real FROM m""")
def padded_days(spark, folder):
    """Days of a user as rows of one length."""
    day = F.floor(F.col("us") / (24 * HOUR)).alias("day")
    days = indexed(spark, folder).groupBy("user_id", day).agg(F.sort_array(F.collect_list(F.struct("idx", "event_id", "value"))).alias("l"))
    days = days.select("user_id", "day", F.col("l.event_id").alias("ids"), F.col("l.value").alias("vs"))
    out = R.pad_to_longest(days, U, {"ids": -1, "vs": 0.0})
    return out.select(
        "user_id", "day", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.round(A.array_total("vs"), 6).alias("total"),
        F.size("mask").alias("width"), "length", F.aggregate("mask", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("real"),
    )
