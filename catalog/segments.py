"""Segmentation of event values as sample series."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import EVENTS, events, query
from catalog.events import INDEXED, indexed
from tidemark.operators import segments as S
from tidemark.operators.scoring import split_segments
from tidemark.plans import segmentation as P
from tidemark.scan import Scan, with_blocks

U = ["user_id"]
# one event is one sample; four samples are one second
RATE = 4


def samples(spark, folder):
    return indexed(spark, folder).select("user_id", F.col("idx").alias("pos"), (F.col("value") / 500).alias("v"))


@query(f"""WITH {INDEXED}, n AS (SELECT user_id, max(idx) + 1 AS n FROM ix GROUP BY 1), f AS (SELECT user_id, n, unnest(generate_series(0, (n + 8 - 8) // 2)) AS frame FROM n)
SELECT f.user_id, f.frame, n AS samples, round(sqrt(coalesce(sum((value / 500) * (value / 500)), 0) / 8), 6) AS rms,
  round(20 * log10(greatest(sqrt(coalesce(sum((value / 500) * (value / 500)), 0) / 8), 1e-10)), 4) AS db
FROM f LEFT JOIN ix ON ix.user_id = f.user_id AND ix.idx + 4 >= frame * 2 AND ix.idx + 4 < frame * 2 + 8 GROUP BY 1, 2, 3""")
def hopping_rms_db(spark, folder):
    out = S.hopping_rms(samples(spark, folder), U, "pos", "v", 8, 2)
    return out.select("user_id", "frame", "samples", F.round("rms", 6).alias("rms"), F.round(S.decibels("rms"), 4).alias("db"))


@query(f"""WITH {INDEXED} SELECT user_id, idx // 2 AS pos, round(avg(value), 6) AS v FROM ix GROUP BY 1, 2""")
def mix_channels(spark, folder):
    two = indexed(spark, folder).select("user_id", F.floor(F.col("idx") / 2).alias("pos"), F.col("value").alias("v"))
    return S.mix_channels(two, U, "pos", "v").withColumn("v", F.round("v", 6))


VOICE = ["voice"]
VOICES = f"{EVENTS}, vx AS (SELECT user_id % 7 AS voice, value / 500 AS v, row_number() OVER (PARTITION BY user_id % 7 ORDER BY us, event_id) - 1 AS pos FROM ev)"


def voices(spark, folder):
    """Events of several users as one series each, so that series hold many silences."""
    e = events(spark, folder).select((F.col("user_id") % 7).alias("voice"), "us", "event_id", (F.col("value") / 500).alias("v"))
    rows = Scan(with_blocks(e, VOICE, "us"), VOICE, ["us", "event_id"]).row_number("_n").columns()
    return rows.select("voice", (F.col("_n") - 1).alias("pos"), "v")


def silences_sql(hop, kept, interval, settings):
    """Pieces between silences by the rules of a pass over the frames: relation ``pc`` (voice, setting, start, end, n).

    Frames are two hops long. ``settings`` gives (setting, thr, mf): threshold and least frames from cut to cut.
    """
    return f"""{VOICES}, st(setting, thr, mf) AS (VALUES {settings}), nv AS (SELECT voice, max(pos) + 1 AS n FROM vx GROUP BY 1),
  ce AS (SELECT voice, (pos + {hop}) // {hop} AS cell, sum(v * v) AS p FROM vx GROUP BY 1, 2),
  fr AS (SELECT voice, n, frame, sqrt(sum(p) / {2 * hop}) AS rms FROM (SELECT voice, n, unnest(generate_series(0, n // {hop})) AS frame FROM nv) f JOIN ce USING (voice) WHERE cell IN (frame, frame + 1) AND frame * {hop} + {2 * hop} <= n + {2 * hop} GROUP BY 1, 2, 3),
  la AS (SELECT voice, max(frame) AS last FROM fr GROUP BY 1),
  si AS (SELECT voice, setting, mf, n, frame, rms, frame - row_number() OVER (PARTITION BY voice, setting ORDER BY frame) AS g FROM fr JOIN st ON rms < thr),
  ru AS (SELECT voice, setting, mf, n, g, min(frame) AS s, max(frame) + 1 AS i FROM si GROUP BY ALL),
  cu AS (SELECT r.*, last, arg_min(frame, (rms, frame)) AS anyw, arg_min(frame, (rms, frame)) FILTER (frame <= s + {kept}) AS lft, arg_min(frame, (rms, frame)) FILTER (frame >= i - {kept}) AS rgt,
    arg_min(frame, (rms, frame)) FILTER (frame <= s + {kept} AND frame >= i - {kept}) AS mid FROM ru r JOIN si USING (voice, setting, g) JOIN la USING (voice) GROUP BY ALL),
  ta AS (SELECT voice, setting, mf, n, last, s, i, s = 0 AND i > {kept} AND i <= last AS at_head, i > last AND last + 1 - s >= {interval} AS at_tail, i <= last AND i - s >= {interval} AS cuts,
    CASE WHEN i > last THEN lft WHEN s = 0 THEN 0 WHEN i - s <= {kept} THEN anyw WHEN i - s <= {2 * kept} THEN least(lft, mid) ELSE lft END AS low,
    CASE WHEN i > last THEN last + 2 WHEN i - s <= {kept} THEN anyw WHEN i - s <= {2 * kept} AND s > 0 THEN greatest(rgt, mid) ELSE rgt END AS high FROM cu WHERE (n + {hop - 1}) // {hop} > mf),
  nu AS (SELECT *, row_number() OVER (PARTITION BY voice, setting ORDER BY s) AS rn FROM ta WHERE at_head OR at_tail OR cuts),
  ch AS (SELECT voice, setting, rn, at_head OR at_tail OR i >= mf AS tag, CASE WHEN at_head OR (NOT at_tail AND i >= mf) THEN high ELSE 0 END AS clip FROM nu WHERE rn = 1
    UNION ALL SELECT u.voice, u.setting, u.rn, u.at_head OR u.at_tail OR u.i - c.clip >= u.mf, CASE WHEN u.at_head OR (NOT u.at_tail AND u.i - c.clip >= u.mf) THEN u.high ELSE c.clip END FROM ch c JOIN nu u ON u.voice = c.voice AND u.setting = c.setting AND u.rn = c.rn + 1),
  tg AS (SELECT u.*, lag(high) OVER w AS before, lead(low) OVER w AS following FROM nu u JOIN ch USING (voice, setting, rn) WHERE tag WINDOW w AS (PARTITION BY voice, setting ORDER BY rn)),
  pc AS (SELECT voice, setting, coalesce(before, 0) * {hop} AS "start", least(n, low * {hop}) AS "end", n FROM tg WHERE before IS NOT NULL OR low > 0
    UNION ALL SELECT voice, setting, high * {hop}, least(n, (last + 1) * {hop}), n FROM tg WHERE following IS NULL AND high < last + 1
    UNION ALL SELECT voice, setting, 0, n, n FROM nv CROSS JOIN st WHERE (voice, setting) NOT IN (SELECT voice, setting FROM tg))"""


MS = dict(threshold_db=-22.0, min_length_ms=4000, min_interval_ms=500, hop_ms=250, max_kept_ms=1000)


@query(f"""WITH RECURSIVE {silences_sql(1, 4, 2, "(0, 10 ** (-22 / 20.0::DOUBLE), 16)")} SELECT voice, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end" FROM pc""")
def silence_segments(spark, folder):
    return P.silence_plan(voices(spark, folder), VOICE, "pos", "v", RATE, **MS)


FRAMES = f"""{INDEXED}, nf AS (SELECT user_id, max(idx) + 1 AS n FROM ix GROUP BY 1), ff AS (SELECT user_id, n, unnest(generate_series(0, n // 2)) AS frame FROM nf),
  fr AS (SELECT ff.user_id, n, frame, sqrt(coalesce(sum((value / 500) * (value / 500)), 0) / 8) AS rms FROM ff LEFT JOIN ix ON ix.user_id = ff.user_id AND ix.idx + 4 >= frame * 2 AND ix.idx + 4 < frame * 2 + 8 GROUP BY 1, 2, 3)"""


#: From each frame its cut, two to six seconds on: the last frame below the limit, else the quietest.
@query(f"""WITH RECURSIVE {FRAMES}, db AS (SELECT user_id, n, frame, 20 * log10(greatest(rms, 1e-10)) AS db FROM fr),
  cu AS (SELECT f.user_id, f.n, f.frame, coalesce(max(w.frame) FILTER (w.db < -22), arg_min(w.frame, (w.db, w.frame)), least(f.frame + 12, f.n // 2 + 1)) AS cut
    FROM db f LEFT JOIN db w ON w.user_id = f.user_id AND w.frame >= least(f.frame + 4, f.n // 2) AND w.frame < least(f.frame + 12, f.n // 2 + 1) WHERE f.frame / 2 + 6 < f.n / 4 GROUP BY 1, 2, 3),
  ch AS (SELECT user_id, n, frame, cut FROM cu WHERE frame = 0 UNION ALL SELECT c.user_id, c.n, c.frame, c.cut FROM ch JOIN cu c ON c.user_id = ch.user_id AND c.frame = ch.cut)
SELECT user_id, CAST(frame * 2 AS BIGINT) AS "start", CAST(cut * 2 AS BIGINT) AS "end" FROM ch UNION ALL SELECT user_id, CAST(max(cut) * 2 AS BIGINT), CAST(any_value(n) AS BIGINT) FROM ch GROUP BY 1
UNION ALL SELECT user_id, 0, CAST(n AS BIGINT) FROM nf WHERE n / 4 <= 6""")
def windowed_cut(spark, folder):
    frames = S.hopping_rms(samples(spark, folder), U, "pos", "v", 8, 2)
    return S.windowed_cuts(frames, U, RATE, 2, 2.0, 6.0, limit_db=-22.0)


#: From each frame its cut: the middle of the longest quiet run in the window, else the quietest frame.
@query(f"""WITH RECURSIVE {FRAMES}, db AS (SELECT user_id, n, frame, rms > 0.1 AS voiced, 20 * log10(greatest(rms, 1e-10)) AS db FROM fr),
  wi AS (SELECT f.user_id, f.n, f.frame, w.frame AS x, w.db, w.voiced FROM db f LEFT JOIN db w ON w.user_id = f.user_id AND w.frame >= least(f.frame + 4, f.n // 2) AND w.frame < least(f.frame + 12, f.n // 2 + 1) WHERE f.frame / 2 + 6 < f.n / 4),
  un AS (SELECT user_id, frame, x, x - row_number() OVER (PARTITION BY user_id, frame ORDER BY x) AS g FROM wi WHERE NOT voiced),
  ru AS (SELECT user_id, frame, min(x) AS a, count(*) AS l FROM un GROUP BY user_id, frame, g),
  lo AS (SELECT user_id, frame, a + l // 2 AS middle FROM ru QUALIFY row_number() OVER (PARTITION BY user_id, frame ORDER BY l DESC, a) = 1),
  qu AS (SELECT user_id, n, frame, coalesce(arg_min(x, (db, x)), least(frame + 12, n // 2 + 1)) AS quiet FROM wi GROUP BY 1, 2, 3),
  cu AS (SELECT q.user_id, n, q.frame, coalesce(middle, quiet) AS cut FROM qu q LEFT JOIN lo USING (user_id, frame)),
  ch AS (SELECT user_id, n, frame, cut FROM cu WHERE frame = 0 UNION ALL SELECT c.user_id, c.n, c.frame, c.cut FROM ch JOIN cu c ON c.user_id = ch.user_id AND c.frame = ch.cut)
SELECT user_id, CAST(frame * 2 AS BIGINT) AS "start", CAST(cut * 2 AS BIGINT) AS "end" FROM ch UNION ALL SELECT user_id, CAST(max(cut) * 2 AS BIGINT), CAST(any_value(n) AS BIGINT) FROM ch GROUP BY 1
UNION ALL SELECT user_id, 0, CAST(n AS BIGINT) FROM nf WHERE n / 4 <= 6""")
def unvoiced_cut(spark, folder):
    frames = S.hopping_rms(samples(spark, folder), U, "pos", "v", 8, 2)
    return S.windowed_cuts(frames.withColumn("voiced", F.col("rms") > 0.1), U, RATE, 2, 2.0, 6.0, voiced="voiced")


#: Passes over the pieces: a short piece takes in the next one, a very short last one goes back, until a pass changes nothing.
@query(f"""WITH RECURSIVE {silences_sql(1, 4, 2, "(0, 10 ** (-22 / 20.0::DOUBLE), 16)")},
  sr AS (SELECT voice, list({{'a': "start", 'b': "end"}} ORDER BY "start", "end") AS src FROM pc GROUP BY 1),
  mg AS (SELECT voice, src, 2 AS k, src[1:1] AS o, FALSE AS done FROM sr
    UNION ALL SELECT voice, CASE WHEN k <= len(src) THEN src ELSE t END, CASE WHEN k <= len(src) THEN k + 1 ELSE 2 END,
      CASE WHEN k > len(src) THEN (CASE WHEN again THEN t[1:1] ELSE t END)
        WHEN (o[-1].b - o[-1].a) / 4.0 < 4 AND (greatest(o[-1].b, src[k].b) - o[-1].a) / 4.0 <= 9 THEN list_append(o[1:len(o) - 1], {{'a': o[-1].a, 'b': greatest(o[-1].b, src[k].b)}})
        ELSE list_append(o, src[k]) END, k > len(src) AND NOT again
    FROM (SELECT *, len(list_filter([(x.b - x.a) / 4.0 for x in t], lambda d: d < 4)) > 0 AND len(t) < len(src) AS again FROM (
      SELECT *, CASE WHEN len(o) >= 2 AND (o[-1].b - o[-1].a) / 4.0 < 2 AND (o[-1].b - o[-2].a) / 4.0 <= 9 THEN list_append(o[1:len(o) - 2], {{'a': o[-2].a, 'b': o[-1].b}}) ELSE o END AS t FROM mg WHERE NOT done)))
SELECT voice, CAST(x.a AS BIGINT) AS "start", CAST(x.b AS BIGINT) AS "end" FROM (SELECT voice, unnest(o) AS x FROM mg WHERE done)""")
def short_merge(spark, folder):
    cut = P.silence_plan(voices(spark, folder), VOICE, "pos", "v", RATE, **MS)
    return S.merge_short(cut, VOICE, RATE, 4.0, 9.0)


GRID = ", ".join(f"({5 * k + j}, 10 ** ({t} / 20.0::DOUBLE), {round(100 * m / 1000 / 2)})" for k, t in enumerate(P.GRID_THRESHOLDS) for j, m in enumerate(P.GRID_MIN_LENGTHS_MS))


@query(f"""WITH RECURSIVE {silences_sql(2, 2, 2, GRID)},
  sc AS (SELECT voice, setting, round(sum(CASE WHEN d < 1 THEN (1 - d) * 1.5 WHEN d > 3 THEN d - 3 ELSE 0 END) + abs(count(*) - any_value(n) / 100.0::DOUBLE / 2.0::DOUBLE) * 0.5::DOUBLE, 9) AS score FROM (SELECT *, ("end" - "start") / 100.0::DOUBLE AS d FROM pc) GROUP BY 1, 2),
  bt AS (SELECT voice, arg_min(setting, (score, setting)) AS setting, min(score) AS score FROM sc GROUP BY 1)
SELECT voice, CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", ({list(P.GRID_THRESHOLDS)})[setting // 5 + 1]::INTEGER AS threshold_db, ({list(P.GRID_MIN_LENGTHS_MS)})[setting % 5 + 1]::INTEGER AS min_length_ms, round(score, 6) AS score FROM pc JOIN bt USING (voice, setting)""")
def grid_search_segments(spark, folder):
    out = P.grid_search(voices(spark, folder), VOICE, "pos", "v", 100, 1.0, 3.0, min_interval_ms=40, max_kept_ms=40)
    return out.withColumn("score", F.round("score", 6))


@query()
def three_stage(spark, folder):
    return P.three_stage(samples(spark, folder), U, "pos", "v", 100, 0.2, 0.5)


@query(f"""WITH {INDEXED}, s AS (SELECT user_id, idx // 20 AS seg, min(idx) AS a, max(idx) + 1 AS b FROM ix GROUP BY 1, 2), n AS (SELECT user_id, max(idx) + 1 AS n FROM ix GROUP BY 1)
SELECT user_id, count(*) AS segments, round(sum(CASE WHEN (b - a) / 4.0 < 4 THEN (4 - (b - a) / 4.0) * 1.5 WHEN (b - a) / 4.0 > 4.5 THEN (b - a) / 4.0 - 4.5 ELSE 0 END) + abs(count(*) - any_value(n) / 4.0 / 4.25) * 0.5, 6)::DOUBLE AS score FROM s JOIN n USING (user_id) GROUP BY 1""")
def segmentation_score(spark, folder):
    ix = samples(spark, folder)
    seg = ix.groupBy("user_id", F.floor(F.col("pos") / 20).alias("seg")).agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    lengths = ix.groupBy("user_id").agg((F.max("pos") + 1).alias("samples"))
    return S.segmentation_score(seg, lengths, U, RATE, 4.0, 4.5).withColumn("score", F.round("score", 6))


def loud_runs(values):
    """Small splitter: runs of values from 0.08 on."""
    pieces, start = [], None
    for i, v in enumerate([*values, 0.0]):
        if v >= 0.08 and start is None:
            start = i
        elif v < 0.08 and start is not None:
            pieces.append((start, i))
            start = None
    return pieces


@query(f"""WITH {VOICES}, r AS (SELECT voice, pos, pos - row_number() OVER (PARTITION BY voice ORDER BY pos) AS g FROM vx WHERE v >= 0.08)
SELECT voice, CAST(min(pos) AS BIGINT) AS "start", CAST(max(pos) + 1 AS BIGINT) AS "end", min(pos) / 4.0::DOUBLE AS "offset" FROM r GROUP BY voice, g""")
def split_in_blocks(spark, folder):
    """A splitter that is never given more than 40 samples of a series and one more on both sides."""
    whole = voices(spark, folder).withColumn("segment", F.lit(0).cast("bigint"))
    return split_segments(whole, VOICE, "segment", "pos", "v", RATE, loud_runs, block=40, reach=1)
