"""Queries over interval series made from events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import EVENTS, HOUR, days, events, query, table
from catalog.events import INDEXED, indexed
from tidemark.functions import pitch as N
from tidemark.operators import evaluate as E
from tidemark.operators import intervals as V
from tidemark.operators import segments as S
from tidemark.plans.consensus import consensus_timeline
from tidemark.plans.curves import pitch_curve

U = ["user_id"]
MINUTE = HOUR // 60


def spans(spark, folder):
    """Every event opens an interval of its value in minutes."""
    return events(spark, folder).select(
        "user_id", "event_id", "event_type", F.col("us").alias("a"), (F.col("us") + F.rint(F.col("value") * MINUTE).cast("bigint")).alias("b")
    )


SPANS = f"{EVENTS}, sp AS (SELECT user_id, event_id, event_type, us AS a, us + CAST(round_even(value * {MINUTE}, 0) AS BIGINT) AS b FROM ev)"


@query(f"""WITH {SPANS} SELECT l.user_id, l.event_id, count(*) AS hits, CAST(sum(least(l.b, r.b) - greatest(l.a, r.a)) AS BIGINT) AS shared
FROM sp l JOIN sp r ON l.user_id = r.user_id AND l.a < r.b AND r.a < l.b WHERE l.event_type = 'error' AND r.event_type = 'click' GROUP BY 1, 2""")
def interval_overlap_join(spark, folder):
    s = spans(spark, folder)
    left = s.filter("event_type = 'error'").drop("event_type")
    right = s.filter("event_type = 'click'").select("user_id", F.col("a").alias("c"), F.col("b").alias("d"))
    pairs = V.overlap_join(left, right, U, ("a", "b"), ("c", "d"), float(HOUR), levels=2)
    return pairs.groupBy("user_id", "event_id").agg(
        F.count(F.lit(1)).alias("hits"), F.sum(F.least("b", "d") - F.greatest("a", "c")).alias("shared")
    )


@query(f"""WITH {SPANS} SELECT p.event_id, min(s.event_id) AS covered_by FROM sp p JOIN sp s ON p.user_id = s.user_id AND s.a <= p.a AND p.a < s.b
WHERE p.event_type = 'purchase' AND s.event_type = 'view' GROUP BY 1""")
def point_in_interval(spark, folder):
    s = spans(spark, folder)
    points = s.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("a").alias("t"))
    cover = s.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("covered_by"), F.col("a").alias("c"), F.col("b").alias("d"))
    return V.points_in_intervals(points, cover, U, "t", ("c", "d"), "covered_by", float(HOUR), levels=2).select("event_id", "covered_by")


@query(f"""WITH {EVENTS}, m AS (SELECT DISTINCT user_id, us FROM ev WHERE event_type = 'purchase')
SELECT c.event_id, arg_min(m.us, abs(m.us - c.us) * 2 + CASE WHEN m.us > c.us THEN 1 ELSE 0 END) AS nearest FROM ev c LEFT JOIN m USING (user_id) WHERE c.event_type = 'click' GROUP BY c.event_id""")
def nearest_asof(spark, folder):
    e = events(spark, folder)
    marks = e.filter("event_type = 'purchase'").select("user_id", F.col("us").alias("m"))
    return V.nearest_times(e.filter("event_type = 'click'").select("user_id", "event_id", "us"), marks, U, "us", "m").select("event_id", "nearest")


@query(f"""WITH {INDEXED}, l AS (SELECT user_id, max(idx) AS last FROM ix GROUP BY 1)
SELECT x.event_id, f.event_type = 'error' AS flagged FROM ix x JOIN l USING (user_id) JOIN ix f ON f.user_id = x.user_id AND f.idx = least(l.last, greatest(0, CAST(round_even(x.value / 5.0, 0) AS BIGINT)))""")
def nearest_index(spark, folder):
    ix = indexed(spark, folder)
    flags = ix.select("user_id", F.col("idx").alias("i"), (F.col("event_type") == "error").alias("flagged"))
    return S.nearest_flags(ix.select("event_id", "user_id", "value"), flags, U, F.col("value"), 5.0, "i", "flagged").select("event_id", "flagged")


RANGES = """r AS (SELECT user_id, event_id, idx / 4.0::DOUBLE AS o, value / 40 AS d FROM ix WHERE event_type = 'signup'),
  l AS (SELECT user_id, max(idx) + 1 AS n FROM ix GROUP BY 1),
  q AS (SELECT r.user_id, r.event_id, CAST(round_even(o * 4, 0) AS BIGINT) AS s, least(n, CAST(round_even((o + d) * 4, 0) AS BIGINT)) AS e FROM r JOIN l USING (user_id))"""


def _ranges(spark, folder):
    ix = indexed(spark, folder)
    r = ix.filter("event_type = 'signup'").select("user_id", "event_id", (F.col("idx") / 4).alias("o"), (F.col("value") / 40).alias("d"))
    return V.reslice(ix.select("user_id", "idx", "value"), r, U, "idx", "o", "d", 4, 8)


@query(f"""WITH {INDEXED}, {RANGES} SELECT q.event_id, s AS range_start, e AS range_end, count(*) AS n, round(sum(value), 6) AS total FROM q JOIN ix ON ix.user_id = q.user_id AND idx >= s AND idx < e GROUP BY 1, 2, 3""")
def range_reslice(spark, folder):
    cut, _ = _ranges(spark, folder)
    return cut.groupBy("event_id", "range_start", "range_end").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"""WITH {INDEXED}, {RANGES} SELECT event_id, 'empty range' AS rule FROM q WHERE s >= e""")
def empty_ranges(spark, folder):
    return _ranges(spark, folder)[1].select("event_id", "rule")


@query(f"""WITH {INDEXED}, p AS (SELECT user_id, event_type AS mark, us AS a, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS b FROM ev),
  t AS (SELECT user_id, event_type AS mark, us AS a, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS b FROM ev WHERE event_type <> 'view'),
  s AS (SELECT mark, sum((b - a) / {HOUR}) AS s FROM (SELECT * FROM p UNION ALL SELECT * FROM t) WHERE b IS NOT NULL GROUP BY 1),
  c AS (SELECT p.mark, sum((least(p.b, t.b) - greatest(p.a, t.a)) / {HOUR}) AS c FROM p JOIN t ON p.user_id = t.user_id AND p.mark = t.mark AND p.a < t.b AND t.a < p.b GROUP BY 1)
SELECT mark, round(coalesce(c, 0), 4) AS intersection, round(s - coalesce(c, 0), 4) AS "union", round(coalesce(c, 0) / (s - coalesce(c, 0)), 6) AS iou FROM s LEFT JOIN c USING (mark)""")
def interval_iou(spark, folder):
    e = events(spark, folder).select("user_id", "us", (F.col("us") / HOUR).alias("h"), F.col("event_type").alias("m"))
    tier = lambda df: E.tier_intervals(df, U, "us", "h", "m")
    out = E.interval_iou(tier(e), tier(e.filter("m <> 'view'")), U, 24.0)
    return out.select("mark", F.round("intersection", 4).alias("intersection"), F.round("union", 4).alias("union"), "iou")


def _tiers(spark, folder):
    ix = indexed(spark, folder)
    hours = F.col("us") / HOUR
    pred = ix.select("user_id", "idx", hours.alias("time"), F.col("event_type").alias("mark"))
    target = ix.select("user_id", "idx", F.rint(hours).alias("time"), F.col("event_type").alias("mark"))
    return pred, target


@query(f"""WITH {INDEXED}, d AS (SELECT user_id, idx, us / {HOUR} AS p, round_even(us / {HOUR}, 0) AS t FROM ix)
SELECT user_id, round(sum(abs(p - t)), 4) AS distance, count(*) AS points, CAST(0 AS BIGINT) AS errors, FALSE AS rejected, round(max_by(t, idx) - min_by(t, idx), 4) AS span FROM d GROUP BY 1""")
def boundary_displacement(spark, folder):
    out = E.boundary_displacement(*_tiers(spark, folder), U)
    return out.select("user_id", F.round("distance", 4).alias("distance"), "points", "errors", "rejected", F.round("span", 4).alias("span"))


@query(f"""WITH {INDEXED}, d AS (SELECT user_id, event_type, us / {HOUR} AS p, round_even(us / {HOUR}, 0) AS t FROM ix),
  s AS (SELECT user_id, coalesce(sum(abs(p - t)) FILTER (event_type <> 'view'), 0) AS d, count(*) FILTER (event_type <> 'view') AS n, count(*) FILTER (event_type = 'view') AS e, max(t) - min(t) AS span FROM d GROUP BY 1),
  a AS (SELECT round(sum(d), 6) AS d, sum(n) AS n, sum(e) AS e, sum(span) AS s FROM s)
SELECT round(d, 3) AS distance, round(d / s, 6) AS ratio, round(d / s / (1 - e / n), 6) AS weighted_ratio FROM a""")
def displacement_totals(spark, folder):
    pred, target = _tiers(spark, folder)
    out = E.displacement_totals(E.boundary_displacement(pred.filter("mark <> 'view'"), target, U))
    return out.withColumn("distance", F.round("distance", 3))


#: The table of costs row by row: a step right costs a fixed sum, so a row is a running minimum without it.
@query(f"""WITH RECURSIVE {INDEXED}, ch AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 1 ELSE 2 END AS step FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
  su AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY idx) AS upto FROM ch),
  li AS (SELECT user_id, list(us / {HOUR} ORDER BY idx) AS p, list(round_even(us / {HOUR}, 0) ORDER BY idx) AS t, list(event_type ORDER BY idx) AS m, list_prepend(0, list(CAST(upto AS INTEGER) ORDER BY idx)) AS r, count(*) AS n FROM su GROUP BY 1),
  dp AS (SELECT user_id, p, t, m, r, n, 0 AS i, [CAST(2 * j AS INTEGER) for j in range(0, n + 1)] AS c FROM li
    UNION ALL SELECT user_id, p, t, m, r, n, i + 1, [CAST(r[j] + list_min(g[1:j]) AS INTEGER) for j in range(1, n + 2)] FROM (
      SELECT user_id, p, t, m, r, n, i, c, [(CASE WHEN j = 0 THEN i + 1 ELSE least(c[j] + (CASE WHEN abs(p[i + 1] - t[j]) >= 0.2 AND abs(p[i + 1] - t[j]) < 0.4 THEN 1 ELSE 0 END) + (CASE WHEN m[i + 1] <> m[j] THEN 1 ELSE 0 END), c[j + 1] + 1) END) - r[j + 1] for j in range(0, n + 1)] AS g FROM dp WHERE i < n))
SELECT user_id, CAST(c[n + 1] AS BIGINT) AS edits, CAST(2 * n AS BIGINT) AS total, round(c[n + 1] / (2 * n), 6) AS edit_ratio FROM dp WHERE i = n""")
def label_edit_count(spark, folder):
    return E.label_edits(*_tiers(spark, folder), U, 0.2, 0.4)


def order_spans(spark, folder):
    """Orders of a customer as intervals in days; the value decides the length."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("id"), days("o_orderdate").cast("double").alias("a"),
        F.col("o_orderpriority").alias("label"),
        (days("o_orderdate") + F.floor(F.col("o_totalprice") / 10000) + 1).cast("double").alias("b"),
    )


ORDERS = """od AS (SELECT o_custkey AS cust, o_orderkey AS id, (epoch_us(o_orderdate) // 86400000000)::DOUBLE AS a, o_orderpriority AS label,
  (epoch_us(o_orderdate) // 86400000000 + floor(o_totalprice / 10000) + 1)::DOUBLE AS b FROM orders)"""
LENGTH = 12000.0


@query(f"""WITH {ORDERS}, w AS (SELECT *, lead(a) OVER (PARTITION BY cust ORDER BY a, id) AS nx, lag(b) OVER (PARTITION BY cust ORDER BY a, id) AS pv FROM od)
SELECT id, CASE WHEN pv IS NULL AND (a < 0 OR (a > 0 AND a < 40 AND b - a > 40)) THEN 0 ELSE a END AS a,
  CASE WHEN nx IS NULL AND b >= {LENGTH} - 40 THEN {LENGTH} WHEN nx - b > 0 AND nx - b <= 40 THEN nx ELSE b END::DOUBLE AS b FROM w""")
def close_small_gaps(spark, folder):
    o = order_spans(spark, folder).withColumn("length", F.lit(LENGTH))
    return V.close_small_gaps(o, ["cust"], ["a", "id"], "a", "b", "length", 40.0).select("id", "a", "b")


@query(f"""WITH {ORDERS}, w AS (SELECT *, lead(a) OVER (PARTITION BY cust ORDER BY a, id) AS nx, coalesce(lag(b) OVER (PARTITION BY cust ORDER BY a, id), 0) AS pv FROM od),
  u AS (SELECT cust, pv AS a, a AS b, 'SP' AS label FROM w WHERE a > pv UNION ALL SELECT cust, a, b, label FROM w UNION ALL SELECT cust, b, {LENGTH}, 'SP' FROM w WHERE nx IS NULL AND b < {LENGTH})
SELECT cust, count(*) AS parts, count(*) FILTER (label = 'SP') AS fillers, sum(b - a) FILTER (label = 'SP') AS filled FROM u GROUP BY 1""")
def fill_gaps_complement(spark, folder):
    o = order_spans(spark, folder).withColumn("length", F.lit(LENGTH))
    out = V.fill_complement(o, ["cust"], ["a", "id"], "a", "b", "label", "length")
    filler = F.col("label") == "SP"
    return out.groupBy("cust").agg(
        F.count(F.lit(1)).alias("parts"), F.count_if(filler).alias("fillers"), F.sum(F.when(filler, F.col("b") - F.col("a"))).alias("filled")
    )


@query(f"""WITH {ORDERS}, w AS (SELECT *, lead(a) OVER (PARTITION BY cust ORDER BY a, id) AS nx FROM od), v AS (SELECT cust, arg_min(id, (a, id)) AS id FROM w WHERE nx IS NOT NULL AND b <> nx GROUP BY 1)
SELECT cust, 'contiguity' AS rule FROM v""")
def timeline_integrity(spark, folder):
    o = order_spans(spark, folder).withColumn("place", F.struct("a", "id"))
    rows = V.timeline_violations(o.withColumn("at", F.col("a") + F.col("id") * 1e-9), ["cust"], "at", "a", "b", "label")
    return rows.select("cust", "rule")


@query(f"""WITH {ORDERS}, n AS (SELECT * FROM od WHERE label = '1-URGENT'), e AS (SELECT * FROM od WHERE label <> '1-URGENT'),
  p AS (SELECT n.id, n.cust, n.a, n.b, e.a AS ea, e.b AS eb FROM n JOIN e ON n.cust = e.cust AND n.a < e.b AND e.a < n.b),
  w AS (SELECT *, coalesce(max(eb) OVER (PARTITION BY id ORDER BY ea, eb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a) AS f, lead(ea) OVER (PARTITION BY id ORDER BY ea, eb) AS more, max(eb) OVER (PARTITION BY id) AS cov FROM p),
  u AS (SELECT id, f AS a, ea AS b FROM w WHERE ea > f UNION ALL SELECT id, cov, b FROM w WHERE more IS NULL AND cov < b)
SELECT id, a, b FROM u WHERE b - a >= 2 UNION ALL SELECT id, a, b FROM n WHERE id NOT IN (SELECT id FROM p)""")
def subtract_intervals(spark, folder):
    o = order_spans(spark, folder)
    new, old = o.filter("label = '1-URGENT'").select("cust", "id", "a", "b"), o.filter("label <> '1-URGENT'").select("cust", "a", "b")
    return V.subtract_intervals(new, old, ["cust"], "id", ("a", "b"), 60.0, 2.0).select("id", "a", "b")


@query(f"""WITH {ORDERS} SELECT n.id FROM od n WHERE label = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM od e WHERE e.label <> '1-URGENT' AND n.cust = e.cust AND n.a < e.b AND e.a < n.b)""")
def insert_free(spark, folder):
    o = order_spans(spark, folder)
    new, old = o.filter("label = '1-URGENT'").select("cust", "id", "a", "b"), o.filter("label <> '1-URGENT'").select("cust", "a", "b")
    return V.insert_free(new, old, ["cust"], "id", ("a", "b"), 60.0)[0].select("id")


#: Lexical rows left to right: the row before counts with its repaired end.
@query(f"""WITH RECURSIVE {ORDERS}, al AS (SELECT *, a + id * 1e-9::DOUBLE AS pl, label = '5-LOW' AS filler FROM od),
  lk AS (SELECT *, greatest(0, b - a) AS d, row_number() OVER w AS k, row_number() OVER (PARTITION BY cust ORDER BY greatest(0, b - a), pl) AS rk, count(*) OVER (PARTITION BY cust) AS n,
    greatest(0, lead(b) OVER w - lead(a) OVER w) AS nd, lead(a) OVER w AS ns FROM al WHERE NOT filler WINDOW w AS (PARTITION BY cust ORDER BY pl)),
  rp AS (SELECT cust, k, id, pl, a, b AS e, FALSE AS fixed FROM lk WHERE k = 1
    UNION ALL SELECT cust, k, id, pl, a, CASE WHEN fixed THEN ns ELSE b END, fixed FROM (
      SELECT l.cust, l.k, l.id, l.pl, l.a, l.b, l.ns, coalesce(l.n >= 3 AND l.rk <= greatest(3, floor(l.n * 0.15::DOUBLE + 0.999999::DOUBLE)) AND least(greatest(0, r.e - r.a), l.nd) > 0
        AND l.d < least(greatest(0, r.e - r.a), l.nd) * 0.6::DOUBLE AND l.ns > l.b, FALSE) AS fixed FROM rp r JOIN lk l ON l.cust = r.cust AND l.k = r.k + 1)),
  ou AS (SELECT al.id, al.a, coalesce(rp.e, al.b) AS b, al.filler, last_value(rp.fixed IGNORE NULLS) OVER (PARTITION BY al.cust ORDER BY al.pl) AS covered FROM al LEFT JOIN rp ON rp.id = al.id)
SELECT id, a, b FROM ou WHERE NOT (filler AND coalesce(covered, FALSE))""")
def repair_short(spark, folder):
    o = order_spans(spark, folder).withColumn("at", F.col("a") + F.col("id") * 1e-9)
    return V.repair_short(o, ["cust"], "at", "a", "b", "label", stop=("5-LOW",)).select("id", "a", "b")


#: Rows left to right with the time up to which the timeline is told.
@query(f"""WITH RECURSIVE {ORDERS}, nu AS (SELECT *, a + id * 1e-9::DOUBLE AS pl, CASE WHEN label IN ('1-URGENT', '2-HIGH') THEN a + (b - a) / 4 END AS v FROM od),
  rw AS (SELECT *, row_number() OVER w AS k, lead(v) OVER w AS nv, count(v) OVER w AS ordinal FROM nu WINDOW w AS (PARTITION BY cust ORDER BY pl)),
  st AS (SELECT cust, CAST(0 AS BIGINT) AS k, 0.0::DOUBLE AS told, 0.0::DOUBLE AS before FROM (SELECT DISTINCT cust FROM rw)
    UNION ALL SELECT r.cust, r.k, CASE WHEN r.v IS NULL THEN greatest(told, r.b) ELSE coalesce(r.nv, r.b) END, told FROM st JOIN rw r ON r.cust = st.cust AND r.k = st.k + 1),
  x AS (SELECT r.*, before, coalesce(nv, b) AS stop FROM rw r JOIN st USING (cust, k))
SELECT cust, 0::INTEGER AS part, b - before AS duration, 0::INTEGER AS voiced, '' AS label, ordinal FROM x WHERE v IS NULL AND b > before
UNION ALL SELECT cust, 0, v - before, 0, '', ordinal FROM x WHERE v > before + 0.005
UNION ALL SELECT cust, 1, greatest(0, stop - greatest(v, before)), 1, label, ordinal FROM x WHERE v IS NOT NULL""")
def anchor_spans(spark, folder):
    o = order_spans(spark, folder).withColumn("at", F.col("a") + F.col("id") * 1e-9)
    o = o.withColumn("nucleus", F.when(F.col("label").isin("1-URGENT", "2-HIGH"), F.col("a") + (F.col("b") - F.col("a")) / 4))
    return V.anchor_spans(o, ["cust"], "at", "a", "b", "label", "nucleus", stop=("5-LOW",)).drop("at")


TIMELINE = f"""{INDEXED}, nx AS (SELECT *, us / {HOUR} AS a, lead(us) OVER (PARTITION BY user_id ORDER BY idx) / {HOUR} AS b FROM ix),
  nn AS (SELECT user_id, idx, a, b, event_type AS label FROM nx WHERE b IS NOT NULL),
  ww AS (SELECT user_id, d AS word, d * 24.0::DOUBLE AS a, d * 24.0::DOUBLE + 24 AS b FROM (SELECT DISTINCT user_id, CAST(floor(us / {24 * HOUR}) AS BIGINT) AS d FROM ev))"""


def _words_and_notes(spark, folder):
    n = E.tier_intervals(events(spark, folder).withColumn("h", F.col("us") / HOUR), U, "us", "h", "event_type")
    notes = n.select("user_id", F.col("start").alias("idx"), "start", "end", F.col("mark").alias("label"))
    day = F.floor(F.col("us") / (24 * HOUR))
    words = events(spark, folder).select("user_id", day.alias("idx")).distinct()
    return words.select("user_id", "idx", (F.col("idx") * 24.0).alias("start"), (F.col("idx") * 24.0 + 24).alias("end")), notes


@query(f"""WITH {TIMELINE}, p AS (SELECT w.user_id, w.word, n.idx, n.label, least(w.b, n.b) - greatest(w.a, n.a) AS d FROM ww w JOIN nn n ON w.user_id = n.user_id AND w.a < n.b AND n.a < w.b),
  k AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY user_id, word ORDER BY idx) = label THEN 0 ELSE 1 END AS new FROM p WHERE d > 1e-4),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id, word ORDER BY idx) - 1 AS part FROM k),
  g AS (SELECT user_id, word, CAST(part AS INTEGER) AS part, any_value(label) AS note, sum(d) AS duration FROM r GROUP BY 1, 2, 3)
SELECT user_id, word, part, note, round(duration, 4) AS duration, CASE WHEN part > 0 THEN 1 ELSE 0 END::INTEGER AS slur FROM g
UNION ALL SELECT user_id, word, 0, 'rest', round(b - a, 4), 0 FROM ww WHERE (user_id, word) NOT IN (SELECT user_id, word FROM g)""")
def notes_to_words(spark, folder):
    words, notes = _words_and_notes(spark, folder)
    out = V.notes_to_words(words, notes, U, 24.0, align=False)
    return out.withColumn("duration", F.round("duration", 4))


@query(f"""WITH {TIMELINE}, mk AS (SELECT DISTINCT user_id, unnest([a, b]) AS m FROM nn),
  wn AS (SELECT *, lead(b) OVER (PARTITION BY user_id ORDER BY word) AS nx FROM ww),
  sn AS (SELECT w.user_id, word, arg_min(m, (abs(m - w.b), m)) AS s FROM wn w JOIN mk ON mk.user_id = w.user_id AND m BETWEEN w.b - 2 AND w.b + 2 WHERE nx IS NOT NULL GROUP BY 1, 2),
  e AS (SELECT w.user_id, w.word, w.a, coalesce(s, w.b) AS b FROM wn w LEFT JOIN sn USING (user_id, word))
SELECT user_id, word AS idx, round(coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY word), a), 6) AS "start", round(b, 6) AS "end" FROM e""")
def aligned_boundaries(spark, folder):
    words, notes = _words_and_notes(spark, folder)
    out = V.align_boundaries(words, notes, U, 2.0)
    return out.select("user_id", "idx", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


#: Four labellings of each user's events, the last with other labels where there are views; it has no vote then.
RUNS = f"""{INDEXED}, rn AS (SELECT user_id, idx, event_type AS label, us / {HOUR} - 473352 AS h FROM ix),
  kr AS (SELECT user_id, unnest(CASE WHEN bool_or(label = 'view') THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS run FROM rn GROUP BY 1)"""


@query(f"""WITH {RUNS}, t AS (SELECT user_id, idx, label, avg(h + run * 0.01) AS a, avg(h + 0.5 + run * 0.02) AS b FROM rn JOIN kr USING (user_id) GROUP BY 1, 2, 3),
  m AS (SELECT *, row_number() OVER w AS n, max(greatest(b, a + 1e-4) - (idx + 1) * 1e-4) OVER w AS top FROM t WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
  e AS (SELECT user_id, idx, label, a, n * 1e-4 + greatest(0, top) AS b FROM m),
  r AS (SELECT user_id, idx, label, greatest(a, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY idx), 0)) AS a, b FROM e),
  w AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY idx) AS nx, lag(b) OVER (PARTITION BY user_id ORDER BY idx) AS pv FROM r),
  c AS (SELECT user_id, idx, label, CASE WHEN pv IS NULL AND (a < 0 OR (a > 0 AND a < 0.1 AND b - a > 0.1)) THEN 0 ELSE a END AS a,
    CASE WHEN nx IS NULL AND b >= 800 - 0.1 THEN 800 WHEN nx - b > 0 AND nx - b <= 0.1 THEN nx ELSE b END AS b FROM w),
  g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY user_id ORDER BY idx), 0) AS pv, lead(a) OVER (PARTITION BY user_id ORDER BY idx) AS nx FROM c),
  u AS (SELECT user_id, pv AS a, a AS b, 'SP' AS label FROM g WHERE a > pv UNION ALL SELECT user_id, a, b, label FROM g UNION ALL SELECT user_id, b, 800, 'SP' FROM g WHERE nx IS NULL AND b < 800)
SELECT user_id, round(a, 3) AS "start", round(b, 3) AS "end", label FROM u""", name="consensus_timeline")
def consensus(spark, folder):
    ix = indexed(spark, folder)
    last = (F.col("run") == 3) & (F.col("event_type") == "view")
    runs = ix.select("user_id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("run"), "idx", "us", "event_type")
    start = F.col("us") / HOUR - 473_352 + F.col("run") * 0.01
    runs = runs.select(
        "user_id", "run", "idx", start.alias("start"), (start + 0.5 + F.col("run") * 0.01).alias("end"), F.when(last, "other").otherwise(F.col("event_type")).alias("label")
    )
    length = ix.select("user_id").distinct().withColumn("length", F.lit(800.0))
    out = consensus_timeline(runs, U, length)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "label")


@query()
def pitch_curves(spark, folder):
    ix = indexed(spark, folder)
    track = ix.select("user_id", F.col("idx").alias("frame"), (50 + F.col("value") / 20).alias("pitch"))
    note = ix.filter("event_type = 'click'").select(
        "user_id", "idx", (F.col("idx") * 0.05).alias("onset"), (F.col("idx") * 0.05 + F.col("value") / 50).alias("offset"), F.lit(55.0).alias("note_pitch")
    )
    return pitch_curve(track, note, U, 0.05, 120.0, 1.0)


@query(f"""WITH {EVENTS} SELECT event_id, CAST(least(127, greatest(0, round_even(value, 0))) AS INTEGER) AS whole,
  CAST(round_even(least(1200, greatest(-1200, (value - 60) * 100.0)), 0) AS INTEGER) AS cents,
  (['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'])[CAST(round_even(least(127, value), 0) AS INTEGER) % 12 + 1] || CAST(CAST(round_even(least(127, value), 0) AS INTEGER) // 12 - 1 AS VARCHAR) AS name FROM ev""")
def pitch_names(spark, folder):
    v = F.col("value")
    return events(spark, folder).select(
        "event_id", N.clamp_pitch("value").alias("whole"), N.cents(v, F.lit(60)).alias("cents"), N.pitch_name(F.least(F.lit(127.0), v)).alias("name")
    )
