"""Joins, gaps and repairs over labelled intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.chain import call_bucket, run_slices
from tidemark.fold import Fold, Ride
from tidemark.functions.checks import STOP_LABELS
from tidemark.functions.grid import _c
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, with_blocks

# Fixed value: the smallest distance between two aligned boundaries.
MIN_GAP = 1e-4
_LEVEL_FACTOR = 64


def split_valid(df: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Intervals with the start clamped to 0: those with ``start < end``, and the rest."""
    clamped = df.withColumn(start, F.greatest(F.lit(0).cast(df.schema[start].dataType), F.col(start)))
    fine = F.coalesce(F.col(start) < F.col(end), F.lit(False))
    return clamped.filter(fine), clamped.filter(~fine).withColumn("rule", F.lit("start < end"))


def _bins(start: Column, end: Column, width: Column) -> tuple[Column, Column]:
    first = F.floor(start / width)
    return first, F.greatest(first, F.ceil(end / width) - 1)


def _level(start: Column, end: Column, width: float, levels: int) -> Column:
    level = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        level = F.when(end - start <= width * _LEVEL_FACTOR**k, F.lit(k)).otherwise(level)
    return level


def _binned(df: DataFrame, start: str, end: str, width: float, levels: int, upward: str | None) -> DataFrame:
    """Rows repeated per bin: at their own level, or at the levels from (above) it."""
    own = _level(F.col(start), F.col(end), width, levels)
    if upward is None:
        chosen = F.array(own)
    else:
        chosen = F.filter(
            F.sequence(F.lit(0), F.lit(levels - 1)), (lambda k: k >= own) if upward == "from" else (lambda k: k > own)
        )
    rows = df.withColumn("_level", F.explode(chosen))
    size = F.lit(float(width)) * F.pow(F.lit(float(_LEVEL_FACTOR)), F.col("_level"))
    first, last = _bins(F.col(start), F.col(end), size)
    return rows.withColumn("_first_bin", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    width: float, levels: int = 1,
) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap.

    Both sides are put into bins of ``width`` and joined on key and bin; a pair
    that shares several bins comes out of the first one only.  With ``levels``
    above 1, intervals longer than ``width`` use bins 64 times as wide per level,
    so a few very long ones do not fill many bins.
    """
    names = [c for c in right.columns if c not in keys]
    clash = set(names) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")

    def join(up_left: str | None, up_right: str | None) -> DataFrame:
        a = _binned(left, *left_span, width, levels, up_left)
        b = _binned(right, *right_span, width, levels, up_right).withColumnRenamed("_first_bin", "_right_first")
        pairs = a.join(b, [*keys, "_level", "_bin"])
        return pairs.filter(
            (F.col(left_span[0]) < F.col(right_span[1]))
            & (F.col(right_span[0]) < F.col(left_span[1]))
            & (F.col("_bin") == F.greatest("_first_bin", "_right_first"))
        ).select(*left.columns, *names)

    if levels == 1:
        return join(None, None)
    return join("from", None).unionByName(join(None, "above"))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, span: tuple[str, str], index: str,
    width: float, levels: int = 1, keep_unmatched: bool = False,
) -> DataFrame:
    """Each point with the lowest-index interval ``start <= time < end`` that covers it.

    Rows of ``points`` must be distinct.
    """
    start, end = span
    names = [c for c in intervals.columns if c not in keys]
    b = _binned(intervals, start, end, width, levels, None)
    a = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    size = F.lit(float(width)) * F.pow(F.lit(float(_LEVEL_FACTOR)), F.col("_level"))
    a = a.withColumn("_bin", F.floor(F.col(time) / size))
    pairs = a.join(b, [*keys, "_level", "_bin"]).filter((F.col(start) <= F.col(time)) & (F.col(time) < F.col(end)))
    hit = pairs.groupBy(*points.columns).agg(
        F.min_by(F.struct(*names), F.struct(index, start)).alias("_hit")
    )
    found = hit.select(*points.columns, *[F.col(f"_hit.{c}").alias(c) for c in names])
    if not keep_unmatched:
        return found
    rest = points.join(found.select(*points.columns), points.columns, "left_anti")
    return found.unionByName(rest, allowMissingColumns=True)


def away_from_edges(time, start, end, limit: float = 0.025, share: float = 0.15) -> Column:
    """False for times within the trimmed edges of a covering interval."""
    d = F.greatest(F.lit(0.0), _c(end) - _c(start))
    trim, place = F.least(F.lit(limit), d * share), _c(time) - _c(start)
    return ~((d > trim * 2) & ((place < trim) | (d - place <= trim)))


def nearest_times(
    points: DataFrame, marks: DataFrame, keys: Sequence[str], time: str, mark: str, name: str = "nearest",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Nearest mark of each point; the earlier one on a tie."""
    keys = list(keys)
    cols = points.columns
    a = points.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"))
    b = marks.select(
        *keys, F.col(mark).cast(points.schema[time].dataType).alias("_t"), F.lit(0).alias("_side"),
    ).distinct()
    both = with_blocks(a.unionByName(b, allowMissingColumns=True), keys, "_t", rows_per_block)
    seen = F.when(F.col("_side") == 0, F.col("_t"))
    both = Scan(both, keys, ["_t", "_side"]).last_valid("_before", seen).next_valid("_after", seen).columns()
    t = F.col("_t")
    nearest = F.when(
        F.col("_after").isNull() | (t - F.col("_before") <= F.col("_after") - t), F.col("_before")
    ).otherwise(F.col("_after"))
    return both.filter("_side = 1").select(*[F.col(f"_row.{c}").alias(c) for c in cols], nearest.alias(name))


def reslice(
    samples: DataFrame, ranges: DataFrame, keys: Sequence[str], pos: str, offset: str, duration: str, rate: int, width: int,
) -> tuple[DataFrame, DataFrame]:
    """Samples of ``[round(offset*rate), round((offset+duration)*rate))``, and the empty ranges."""
    lengths = samples.groupBy(*keys).agg((F.max(pos) + 1).alias("_samples"))
    placed = (
        ranges.join(lengths, list(keys))
        .withColumn("_start", F.greatest(F.lit(0), F.rint(F.col(offset) * rate)).cast("bigint"))
        .withColumn(
            "_end", F.least(F.col("_samples"), F.rint((F.col(offset) + F.col(duration)) * rate).cast("bigint"))
        )
        .drop("_samples")
    )
    fine = F.col("_start") < F.col("_end")
    spans = placed.filter(fine)
    bins = spans.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_end") - 1) / width)))
    )
    cut = (
        samples.withColumn("_bin", F.floor(F.col(pos) / width))
        .join(bins, [*keys, "_bin"])
        .filter((F.col(pos) >= F.col("_start")) & (F.col(pos) < F.col("_end")))
        .drop("_bin")
        .withColumnsRenamed({"_start": "range_start", "_end": "range_end"})
    )
    return cut, placed.filter(~fine).select(*ranges.columns, F.lit("empty range").alias("rule"))


class _Clamp(Ride):
    """A boundary wanted at one place, at least ``MIN_GAP`` behind the one before and ahead of the next."""

    step = MIN_GAP

    def fresh(self, want, following, raw, low):
        return self.next(low, want, following, raw, low)

    def next(self, state, want, following, raw, low):
        least, most = state + MIN_GAP, following - MIN_GAP
        return min(max(want, least), most) if least < most else raw

    def limits(self, want, following, raw, low):
        return want - MIN_GAP, following - 2 * MIN_GAP

    def sides(self, states, want, following, raw, low):
        least, most = states + MIN_GAP, following - MIN_GAP
        return np.where(~(least < most), 1, np.where(least < want, -1, 0))

    def broken(self, side, want, following, raw, low):
        return raw if side > 0 else min(want, following - MIN_GAP)


def align_boundaries(
    words: DataFrame, notes: DataFrame, series: Sequence[str], tol: float = 0.01, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Word intervals with inner boundaries snapped to note boundaries within ``tol``.

    ``words`` and ``notes`` hold ``idx, start, end``.  Snapped boundaries stay
    strictly increasing: each is clamped between the one before and the next
    raw one.  A boundary that is not moved down cannot run into the one before.
    """
    keys = list(series)
    rows = with_blocks(words, keys, "idx", rows_per_block)
    rows = Scan(rows, keys, ["idx"]).lead("_next", "end").columns()
    marks = notes.select(*keys, F.explode(F.array("start", "end")).alias("mark"))
    inner = rows.filter(F.col("_next").isNotNull()).select(*keys, "idx", F.col("end").alias("raw"), "_next")
    near = nearest_times(inner, marks, keys, "raw", "mark", rows_per_block=rows_per_block)
    snapped = F.when(F.abs(F.col("nearest") - F.col("raw")) <= tol, F.col("nearest")).otherwise(F.col("raw"))
    near = near.select(*keys, "idx", "raw", "_next", snapped.alias("_want"))
    near = with_blocks(near, keys, "idx", block_limit(rows, rows_per_block))
    free = (F.col("_want") >= F.col("raw")) & (F.col("_next") - F.col("raw") > 3 * MIN_GAP)
    near = Scan(near, keys, ["idx"]).lag("_raw_before", "raw").columns()
    # the first boundary comes after the start of the series
    near = near.withColumn("_low", F.coalesce("_raw_before", F.lit(0.0)))
    near = near.withColumn("_start", free)
    limit = block_limit(near, rows_per_block)
    moved = Fold(_Clamp(), keys, ["idx"], ["_want", "_next", "raw", "_low"], "_start").states(near, "_moved", limit).select(*keys, "idx", "_moved")
    rows = rows.drop("_next").join(moved, [*keys, "idx"], "left").withColumn("_end", F.coalesce("_moved", "end"))
    rows = Scan(rows, keys, ["idx"]).lag("_start", "_end").columns()
    others = [c for c in words.columns if c not in (*keys, "idx", "start", "end")]
    return rows.select(
        *keys, "idx", F.coalesce("_start", "start").alias("start"), F.col("_end").alias("end"), *others
    )


def notes_to_words(
    words: DataFrame, notes: DataFrame, series: Sequence[str], width: float, tol: float = 0.01, voiced: str | None = None,
    align: bool = True, levels: int = 1, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Notes clipped to words: ``(series, word, part, note, duration, slur)``.

    ``words`` holds ``idx, start, end`` and the optional ``voiced`` flag (0 turns
    the whole word into a rest); ``notes`` holds ``idx, start, end, label``.
    Overlaps of at most 1e-4 do not count, equal neighbours inside a word are
    merged, a word without notes is a rest.
    """
    keys = list(series)
    w = align_boundaries(words, notes, keys, tol, rows_per_block) if align else words
    w = w.filter(F.col("end") > F.col("start")).select(
        *keys, F.col("idx").alias("word"), F.col("start").alias("_ws"), F.col("end").alias("_we"),
        (F.col(voiced) != 0 if voiced else F.lit(True)).alias("_voiced"),
    )
    n = notes.select(
        *keys, F.col("idx").alias("_note"), F.col("start").alias("_ns"), F.col("end").alias("_ne"), F.col("label").alias("note")
    )
    pairs = overlap_join(w.filter("_voiced"), n, keys, ("_ws", "_we"), ("_ns", "_ne"), width, levels)
    pairs = pairs.withColumn("_d", F.least("_we", "_ne") - F.greatest("_ws", "_ns")).filter(F.col("_d") > MIN_GAP)
    inside = Window.partitionBy(*keys, "word").orderBy("_note")
    new = ~F.coalesce(F.lag("note").over(inside) == F.col("note"), F.lit(False))
    pairs = pairs.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(inside))
    clipped = pairs.groupBy(*keys, "word", (F.col("_run") - 1).cast("int").alias("part")).agg(
        F.first("note").alias("note"), F.sum("_d").alias("duration")
    )
    rests = w.join(clipped.select(*keys, "word").distinct(), [*keys, "word"], "left_anti").select(
        *keys, "word", F.lit(0).alias("part"), F.lit("rest").alias("note"), (F.col("_we") - F.col("_ws")).alias("duration")
    )
    return clipped.unionByName(rests).withColumn("slur", (F.col("part") > 0).cast("int"))


def close_small_gaps(
    df: DataFrame, series: Sequence[str], order: Sequence[str], start: str, end: str, length: str, gap: float = 0.1,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Extend intervals over gaps of at most ``gap``, and to 0 and ``length`` at the ends."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_before", end).lead("_after", start).columns()
    s, e = F.col(start), F.col(end)
    zero = F.lit(0).cast(df.schema[start].dataType)
    new_start = F.when(
        F.col("_before").isNull() & ((s < 0) | ((s > 0) & (s < gap) & (e - s > gap))), zero
    ).otherwise(s)
    step = F.col("_after") - e
    new_end = (
        F.when(F.col("_after").isNull() & (e >= F.col(length) - gap) & (F.col(length) > s), F.col(length))
        .when((step > 0) & (step <= gap), F.col("_after"))
        .otherwise(e)
    )
    kept = [c for c in df.columns if c not in (start, end)]
    return rows.select(*kept, new_start.alias(start), new_end.alias(end))


def fill_complement(
    df: DataFrame, series: Sequence[str], order: Sequence[str], start: str, end: str, label: str, length: str,
    filler: str = "SP", rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add filler intervals so that every series covers ``[0, length]``."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_before", end).lead("_after", start).columns()
    zero = F.lit(0).cast(df.schema[start].dataType)
    floor = F.coalesce("_before", zero)

    def gap(a: Column, b: Column) -> Column:
        return F.struct(a.alias(start), b.alias(end), F.lit(filler).alias(label))

    pieces = F.array_compact(
        F.array(
            F.when(F.col(start) > floor, gap(floor, F.col(start))),
            F.struct(F.col(start), F.col(end), F.col(label)),
            F.when(F.col("_after").isNull() & (F.col(end) < F.col(length)), gap(F.col(end), F.col(length))),
        )
    )
    return rows.select(*series, length, F.inline(pieces))


def subtract_intervals(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], index: str, span: tuple[str, str], width: float,
    min_length: float = 0.1, levels: int = 1,
) -> DataFrame:
    """Parts of the new intervals that no existing one covers.

    An interval that overlaps nothing stays as it is; parts of others are kept
    from ``min_length`` on.  New intervals must not overlap one another.
    """
    start, end = span
    e = existing.select(*keys, F.col(start).alias("_es"), F.col(end).alias("_ee"))
    pairs = overlap_join(new, e, keys, span, ("_es", "_ee"), width, levels)
    one = Window.partitionBy(*keys, index)
    ahead = one.orderBy("_es", "_ee")
    pairs = pairs.select(
        "*",
        F.coalesce(F.max("_ee").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.col(start)).alias("_free_from"),
        F.lead("_es").over(ahead).alias("_more"),
        F.max("_ee").over(one).alias("_covered"),
    )
    parts = F.array_compact(
        F.array(
            F.when(F.col("_es") > F.col("_free_from"), F.struct(F.col("_free_from").alias("a"), F.col("_es").alias("b"))),
            F.when(
                F.col("_more").isNull() & (F.col("_covered") < F.col(end)),
                F.struct(F.col("_covered").alias("a"), F.col(end).alias("b")),
            ),
        )
    )
    others = [c for c in new.columns if c not in (start, end)]
    cut = (
        pairs.withColumn("_part", F.explode(parts))
        .filter(F.col("_part.b") - F.col("_part.a") >= min_length)
        .select(*others, F.col("_part.a").alias(start), F.col("_part.b").alias(end))
    )
    free = new.join(pairs.select(*keys, index).distinct(), [*keys, index], "left_anti")
    return cut.unionByName(free.select(*others, start, end))


def insert_free(
    new: DataFrame, existing: DataFrame, keys: Sequence[str], index: str, span: tuple[str, str], width: float
) -> tuple[DataFrame, DataFrame]:
    """New intervals that overlap nothing, and those that do."""
    e = existing.select(*keys, F.col(span[0]).alias("_es"), F.col(span[1]).alias("_ee"))
    hit = overlap_join(new, e, keys, span, ("_es", "_ee"), width).select(*keys, index).distinct()
    return new.join(hit, [*keys, index], "left_anti"), new.join(hit, [*keys, index], "left_semi")


def repair_short(
    df: DataFrame, series: Sequence[str], index: str, start: str, end: str, label: str, ratio: float = 0.6,
    portion: float = 0.15, at_least: int = 3, stop: Sequence[str] = STOP_LABELS, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Extend unusually short lexical intervals to the next lexical start.

    A row qualifies when it is among the shortest of its series and shorter than
    ``ratio`` times both lexical neighbours; fillers it then covers are dropped.
    The neighbour before counts with its repaired length.  That makes a repair
    depend on the one before only through "short even then", so the outcome
    follows from the latest sure repair and the latest row that cannot be one.
    """
    keys = list(series)
    df = with_blocks(df, keys, index, rows_per_block)
    limit = block_limit(df, rows_per_block)
    kept = [c for c in df.columns if c != BLOCK]
    lexical = df.select(*kept).filter(~F.coalesce(F.col(label).isin(*stop), F.lit(False)))
    d = F.greatest(F.lit(0.0), F.col(end) - F.col(start))
    ranked = with_blocks(lexical.withColumn("_d", d), keys, "_d", limit)
    ranked = Scan(ranked, keys, ["_d", index]).row_number("_rank").total("_n", F.lit(1)).columns()
    few = F.greatest(F.lit(at_least), F.floor(F.col("_n") * portion + 0.999999))
    rows = ranked.select(
        *keys, index, start, end, "_d", "_n", (F.col("_rank") <= few).alias("_shortest")
    )
    rows = with_blocks(rows, keys, index, limit)
    rows = (
        Scan(rows, keys, [index]).lag("_pd", "_d").lag("_ps", start).lead("_nd", "_d").lead("_ns", start).columns()
    )
    fits = (
        F.col("_shortest") & (F.col("_n") >= 3) & F.col("_pd").isNotNull() & F.col("_nd").isNotNull()
        & (F.col("_ns") > F.col(end))
    )

    def short(before: Column) -> Column:
        least = F.least(before, F.col("_nd"))
        return F.coalesce(fits & (least > 0) & (F.col("_d") < least * ratio), F.lit(False))

    rows = rows.withColumn("_sure", short(F.col("_pd"))).withColumn(
        "_even_then", short(F.greatest(F.lit(0.0), F.col(start) - F.col("_ps")))
    )
    rows = (
        Scan(rows, keys, [index])
        .last_valid("_last_sure", F.when(F.col("_sure"), F.col(index)))
        .last_valid("_last_no", F.when(~F.col("_even_then") & ~F.col("_sure"), F.col(index)))
        .columns()
    )
    repaired = F.col("_last_sure").isNotNull() & (F.col("_last_sure") > F.coalesce("_last_no", F.lit(-1)))
    fixes = rows.select(*keys, index, F.when(repaired, F.col("_ns")).alias("_new_end"), F.lit(True).alias("_lexical"))
    out = df.join(fixes, [*keys, index], "left")
    out = Scan(out, keys, [index]).last_valid(
        "_covers", F.when(F.col("_lexical"), F.col("_new_end").isNotNull())
    ).columns()
    dropped = F.col("_lexical").isNull() & F.coalesce("_covers", F.lit(False))
    return out.filter(~dropped).select(
        *[F.coalesce("_new_end", end).alias(end) if c == end else F.col(c) for c in kept]
    )


def anchor_spans(
    df: DataFrame, series: Sequence[str], index: str, start: str, end: str, label: str, anchor: str,
    stop: Sequence[str] = STOP_LABELS, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Spans from anchor to anchor with the unlabelled rest in between.

    ``anchor`` is the time of the nucleus inside a row, NULL where it has none.
    Returns ``(series, index, part, duration, voiced, label, ordinal)``;
    ``ordinal`` numbers the labelled spans from 1.
    """
    keys = list(series)
    rows = with_blocks(df, keys, index, rows_per_block)
    rows = rows.withColumn("_a", F.when(~F.col(label).isin(*stop), F.col(anchor)))
    rows = Scan(rows, keys, [index]).lead("_next_anchor", "_a").row_number("_row").columns()
    rows = rows.withColumn("_stop", F.when(F.col("_a").isNotNull(), F.coalesce("_next_anchor", end)).otherwise(F.col(end)))
    # where the timeline stands before a row: the last span end, or a later row end after it
    rows = Scan(rows, keys, [index]).running_sum("_run", F.col("_a").isNotNull().cast("bigint")).columns()
    rows = Scan(rows, [*keys, "_run"], [index]).running_max("_reached", "_stop").columns()
    rows = Scan(rows, keys, [index]).lag("_at", "_reached").columns().withColumn("_at", F.coalesce("_at", F.lit(0.0)))
    begin = F.greatest("_a", "_at")
    gap = F.when(F.col("_a").isNull(), F.col(end) - F.col("_at")).when(
        F.col("_a") > F.col("_at") + 0.005, F.col("_a") - F.col("_at")
    )

    def part(k: int, duration: Column, voiced: int, text: Column) -> Column:
        return F.struct(
            F.lit(k).alias("part"), duration.alias("duration"), F.lit(voiced).alias("voiced"), text.alias("label")
        )

    pieces = F.array_compact(
        F.array(
            F.when(gap > 0, part(0, gap, 0, F.lit(""))),
            F.when(
                F.col("_a").isNotNull(), part(1, F.greatest(F.lit(0.0), F.col("_stop") - begin), 1, F.col(label))
            ),
        )
    )
    return rows.select(*keys, index, F.inline(pieces), F.col("_run").alias("ordinal"))


def assign_in_order(spans: DataFrame, labels: DataFrame, keys: Sequence[str], position: str, text: str) -> DataFrame:
    """Give the n-th labelled span the n-th label; spans beyond keep their own."""
    given = labels.select(*keys, (F.col(position) + 1).alias("ordinal"), F.lit(1).alias("voiced"), F.col(text).alias("_given"))
    out = spans.join(given, [*keys, "ordinal", "voiced"], "left")
    return out.select(*[F.coalesce("_given", "label").alias("label") if c == "label" else F.col(c) for c in spans.columns])


def accept_children(parents: DataFrame, start: str, end: str, children: str, appended: bool = False) -> DataFrame:
    """Split the child array of each parent into accepted and rejected children.

    Children must lie inside the parent; with ``appended`` each must start where
    the last accepted one ended, and the parent end moves with them.
    """
    c = F.col(children)
    if not appended:
        fine = lambda x: (x["start"] != x["end"]) & (x["start"] >= F.col(start)) & (x["end"] <= F.col(end))
        return parents.withColumn("rejected", F.filter(c, lambda x: ~fine(x))).withColumn(children, F.filter(c, fine))
    kind = parents.schema[children].dataType.simpleString()
    zero = F.struct(
        F.col(start).alias("at"), F.array().cast(kind).alias("kept"), F.array().cast(kind).alias("rejected")
    )

    def take(s, x):
        fine = (x["start"] != x["end"]) & (x["start"] == s["at"])
        return F.struct(
            F.when(fine, x["end"]).otherwise(s["at"]).alias("at"),
            F.when(fine, F.array_append(s["kept"], x)).otherwise(s["kept"]).alias("kept"),
            F.when(fine, s["rejected"]).otherwise(F.array_append(s["rejected"], x)).alias("rejected"),
        )

    out = parents.withColumn("_taken", F.aggregate(c, zero, take))
    moved = F.when(F.size("_taken.kept") > 0, F.col("_taken.at")).otherwise(F.col(end))
    return out.withColumn(end, moved).withColumn("rejected", F.col("_taken.rejected")).withColumn(
        children, F.col("_taken.kept")
    ).drop("_taken")


def move_edges(df: DataFrame, start: str, end: str, children: str, new_start, new_end) -> DataFrame:
    """Move the edges of a parent and of its edge children where both stay positive."""
    first, last = F.get(F.col(children), F.lit(0)), F.element_at(F.col(children), -1)
    s, e = _c(new_start), _c(new_end)
    start_ok = (s >= 0) & (s < first["end"])
    end_ok = (e > last["start"]) & (last["start"] >= 0)
    size = F.size(children)

    def edge(x, i):
        return F.struct(
            F.when(start_ok & (i == 0), s).otherwise(x["start"]).alias("start"),
            F.when(end_ok & (i == size - 1), e).otherwise(x["end"]).alias("end"),
            x["text"].alias("text"),
        )

    return df.select(
        *[c for c in df.columns if c not in (start, end, children)],
        F.when(start_ok, s).otherwise(F.col(start)).alias(start),
        F.when(end_ok, e).otherwise(F.col(end)).alias(end),
        F.transform(children, edge).alias(children),
        (~start_ok).alias("start_rejected"),
        (~end_ok).alias("end_rejected"),
    )


def timeline_violations(
    df: DataFrame, series: Sequence[str], index: str, start: str, end: str, label: str, children: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """First broken rule of every series that breaks one: ``(series, index, rule, message)``."""
    rows = with_blocks(df, series, index, rows_per_block)
    rows = Scan(rows, series, [index]).lead("_next_start", start).lead("_next_label", label).columns()
    text = F.col(label)

    def broken(rank: int, rule: str, condition: Column, message: Column) -> Column:
        return F.when(
            F.coalesce(condition, F.lit(False)), F.struct(F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), message.alias("message"))
        )

    def said(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    s, e = F.col(start), F.col(end)
    checks = [broken(0, "order", ~(s < e), said("'", text, "' has invalid time order: start=", s, ", end=", e))]
    if children:
        c = F.col(children)
        first, last, n = F.get(c, F.lit(0)), F.element_at(c, -1), F.size(c)
        crooked = F.exists(c, lambda x: ~(x["start"] < x["end"]))
        ends = F.transform(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), lambda x: x["end"])
        starts = F.transform(F.slice(c, 2, F.greatest(n - 1, F.lit(0))), lambda x: x["start"])
        holes = F.exists(F.zip_with(ends, starts, lambda a, b: a != b), lambda x: x)
        checks += [
            broken(1, "children", n == 0, said("'", text, "' has no children")),
            broken(2, "first child", first["start"] != s, said("'", text, "' first child does not start with it")),
            broken(3, "last child", last["end"] != e, said("'", text, "' last child does not end with it")),
            broken(4, "child order", crooked, said("'", text, "' has a child with invalid time order")),
            broken(5, "child gap", holes, said("'", text, "' has children that do not touch")),
        ]
    inner = F.array_min(F.array_compact(F.array(*checks)))
    touch = broken(
        6, "contiguity", e != F.col("_next_start"),
        said("'", text, "' end(", e, ") != next '", F.col("_next_label"), "' start(", F.col("_next_start"), ")"),
    )
    found = rows.select(
        *series, index,
        F.explode(F.array_compact(F.array(
            F.when(inner.isNotNull(), F.struct(F.lit(0).alias("pass"), F.col(index).alias("at"), inner.alias("what"))),
            F.when(touch.isNotNull(), F.struct(F.lit(1).alias("pass"), F.col(index).alias("at"), touch.alias("what"))),
        ))).alias("_f"),
    )
    return (
        found.groupBy(*series)
        .agg(F.min("_f").alias("_f"))
        .select(*series, F.col("_f.at").alias(index), F.col("_f.what.rule").alias("rule"), F.col("_f.what.message").alias("message"))
    )
