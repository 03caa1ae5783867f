"""Segmentation of sample series: energy, silence, windowed cuts and merging.

Positions are whole samples; a segment holds the samples ``[start, end)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.chain import greedy_chain, map_series
from tidemark.functions.grid import _c
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, salted_join, with_blocks


def mix_channels(df: DataFrame, series: Sequence[str], pos: str, value: str) -> DataFrame:
    """Average the channels of a sample position."""
    return df.groupBy(*series, pos).agg(F.avg(value).alias(value))


def hopping_rms(
    samples: DataFrame, series: Sequence[str], pos: str, value: str, frame_length: int, hop: int
) -> DataFrame:
    """Centre-padded root mean square per hop: ``(series, frame, rms, samples)``.

    ``pos`` counts the samples of a series from 0.  Squares are first summed
    into cells that every frame covers whole or not at all, so only cells are
    repeated for overlapping frames.
    """
    half = frame_length // 2
    cell = gcd(gcd(hop, frame_length), half) or gcd(hop, frame_length)
    per_frame, per_hop = frame_length // cell, hop // cell
    lengths = samples.groupBy(*series).agg((F.max(pos) + 1).alias("samples"))
    power = F.col(value).cast("double") * F.col(value).cast("double")
    cells = samples.groupBy(*series, F.floor((F.col(pos) + half) / cell).alias("_cell")).agg(F.sum(power).alias("_power"))
    first = F.greatest(F.lit(0), F.ceil((F.col("_cell") - per_frame + 1) / per_hop))
    last = F.floor(F.col("_cell") / per_hop)
    frames = (
        cells.filter(first <= last)
        .select(*series, F.explode(F.sequence(first, last)).alias("frame"), "_power")
        .groupBy(*series, "frame")
        .agg(F.sqrt(F.sum("_power") / frame_length).alias("rms"))
    )
    inside = F.col("frame") * hop + frame_length <= F.col("samples") + 2 * half
    return (
        salted_join(frames, lengths, series, ["frame"])
        .filter(inside)
        .select(*series, F.col("frame").cast("bigint").alias("frame"), "rms", "samples")
    )


def decibels(rms) -> Column:
    return 20.0 * F.log10(F.greatest(_c(rms), F.lit(1e-10)))


def silence_parameters(
    rate: int, threshold_db: float = -40.0, min_length_ms: int = 5000, min_interval_ms: int = 300, hop_ms: int = 20,
    max_kept_ms: int = 5000,
) -> dict:
    """Frame-based parameters of ``silence_segments`` from milliseconds and decibels."""
    if not min_length_ms >= min_interval_ms >= hop_ms:
        raise ValueError("The following condition must be satisfied: min_length >= min_interval >= hop_size")
    if not max_kept_ms >= hop_ms:
        raise ValueError("The following condition must be satisfied: max_sil_kept >= hop_size")
    interval = rate * min_interval_ms / 1000
    hop = round(rate * hop_ms / 1000)
    return {
        "hop": hop,
        "frame_length": min(round(interval), 4 * hop),
        "threshold": 10 ** (threshold_db / 20.0),
        "min_length": round(rate * min_length_ms / 1000 / hop),
        "min_interval": round(interval / hop),
        "max_kept": round(rate * max_kept_ms / 1000 / hop),
    }


def silences(
    frames: DataFrame, series: Sequence[str], thresholds: Sequence[float], min_interval: int, max_kept: int,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Silences of each series at several thresholds, one row each with the places where it would be cut.

    Returns ``(series, level, samples, _s, _i, _last, _leading, _trailing, _cuts, _low, _high)``; ``level`` is the place
    of the threshold.  Frames are put in order once for all thresholds, and only silent frames go on, once for each
    threshold they are below.
    """
    keys, part = list(series), [*series, "level"]
    rows = with_blocks(frames.select(*keys, "frame", "rms", "samples"), keys, "frame", rows_per_block)
    rows = Scan(rows, keys, ["frame"]).lag("_before", "rms").lead("_after", "rms").maximum("_last", "frame").columns()
    levels = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(t)).alias("_thr")) for k, t in enumerate(thresholds)])
    rows = rows.filter(F.col("rms") < float(max(thresholds)))
    rows = rows.select("*", F.inline(F.filter(levels, lambda t: F.col("rms") < t["_thr"])))
    begins = ~F.coalesce(F.col("_before") < F.col("_thr"), F.lit(False))
    ends = ~F.coalesce(F.col("_after") < F.col("_thr"), F.lit(False))
    rows = (
        Scan(rows, part, ["frame"])
        .last_valid("_s", F.when(begins, F.col("frame")))
        .next_valid("_e", F.when(ends, F.col("frame")))
        .columns()
    )
    frame, s, i = F.col("frame"), F.col("_s"), F.col("_e") + 1
    loudness = F.struct("rms", "frame")

    def quietest(condition: Column) -> Column:
        return F.min_by("frame", F.when(condition, loudness))

    block = [F.min(BLOCK).alias(BLOCK)] if BLOCK in rows.columns else []
    found = rows.groupBy(*part, "_s", "_e").agg(
        *block,
        F.first("_last").alias("_last"),
        F.first("samples").alias("samples"),
        quietest(F.lit(True)).alias("_any"),
        quietest(frame <= s + max_kept).alias("_left"),
        quietest(frame >= i - max_kept).alias("_right"),
        quietest((frame <= s + max_kept) & (frame >= i - max_kept)).alias("_mid"),
    )
    length = i - s
    at_start, at_end = s == 0, F.col("_e") == F.col("_last")
    low = (
        F.when(at_start, F.lit(0))
        .when(length <= max_kept, F.col("_any"))
        .when(length <= 2 * max_kept, F.least("_left", "_mid"))
        .otherwise(F.col("_left"))
    )
    high = (
        F.when(length <= max_kept, F.col("_any"))
        .when((length <= 2 * max_kept) & ~at_start, F.greatest("_right", "_mid"))
        .otherwise(F.col("_right"))
    )
    return found.select(
        *part, "_s", "_last", "samples", *([BLOCK] if block else []),
        i.alias("_i"),
        (~at_end & at_start & (i > max_kept)).alias("_leading"),
        (at_end & (F.col("_last") + 1 - s >= min_interval)).alias("_trailing"),
        (~at_end & (length >= min_interval)).alias("_cuts"),
        F.when(at_end, F.col("_left")).otherwise(low).cast("bigint").alias("_low"),
        F.when(at_end, F.col("_last") + 2).otherwise(high).cast("bigint").alias("_high"),
    ).filter(F.col("_leading") | F.col("_trailing") | F.col("_cuts"))


def cut_at_silences(found: DataFrame, heads: DataFrame, series: Sequence[str], hop: int, span: int) -> DataFrame:
    """Pieces between silences; which silences cut is a greedy chain: ``(series, start, end)`` in samples.

    ``found`` comes from ``silences``, ``heads`` has a row per series with its ``samples``; both hold ``_min``, the
    frames from one cut to the next at least, and ``span`` bounds it.
    """
    keys = list(series)
    short = F.floor((F.col("samples") + hop - 1) / hop) <= F.col("_min")
    found = (
        Scan(found.filter(~short), keys, ["_s"])
        .maximum("_lead_cut", F.when(F.col("_leading"), F.col("_high")))
        .columns()
        .withColumn("_from", F.coalesce(F.col("_lead_cut"), F.lit(0)) + F.col("_min"))
        .withColumn("_next", F.col("_high") + F.col("_min"))
    )
    inner = found.filter(F.col("_cuts") & ~F.col("_leading") & ~F.col("_trailing"))
    tags = greedy_chain(inner, keys, "_i", "_next", "_from", span=float(span)).unionByName(
        found.filter(F.col("_leading") | F.col("_trailing"))
    )
    tags = Scan(tags, keys, ["_s"]).lag("_prev_high", "_high").lead("_next_low", "_low").columns()
    frames_total = F.col("_last") + 1

    def piece(start: Column, end: Column) -> Column:
        return F.struct(
            (start * hop).cast("bigint").alias("start"),
            F.least(F.col("samples"), end * hop).cast("bigint").alias("end"),
        )

    none = F.lit(None)
    pieces = F.array_compact(
        F.array(
            F.when(
                F.col("_prev_high").isNotNull() | (F.col("_low") > 0),
                piece(F.coalesce("_prev_high", F.lit(0)), F.col("_low")),
            ).otherwise(none),
            F.when(
                F.col("_next_low").isNull() & (F.col("_high") < frames_total), piece(F.col("_high"), frames_total)
            ).otherwise(none),
        )
    )
    cut = tags.select(*keys, F.inline(pieces))
    whole = heads.join(tags.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0).cast("bigint").alias("start"), F.col("samples").alias("end")
    )
    return cut.unionByName(whole)


def silence_segments(
    frames: DataFrame, series: Sequence[str], hop: int, threshold: float, min_length: int, min_interval: int, max_kept: int,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Split series at silences; returns ``(series, start, end)`` in samples.

    ``frames`` comes from ``hopping_rms``.  Each silence is reduced to one row
    of places to cut; which silences cut is a greedy chain.
    """
    heads = frames.filter(F.col("frame") == 0).select(*series, "samples", F.lit(min_length).alias("_min"))
    found = silences(frames, series, [threshold], min_interval, max_kept, rows_per_block).drop("level")
    return cut_at_silences(found.withColumn("_min", F.lit(min_length)), heads, series, hop, min_length)


def segment_samples(
    samples: DataFrame, segments: DataFrame, series: Sequence[str], pos: str, width: int
) -> DataFrame:
    """Samples with their segment ``start`` and the position ``_at`` inside it.

    ``width`` is the bin width of the range join, e.g. the usual segment length.
    """
    keys = list(series)
    bins = segments.filter(F.col("end") > F.col("start")).select(
        *keys, "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_bin"),
    )
    return (
        samples.withColumn("_bin", F.floor(F.col(pos) / width))
        .join(bins, [*keys, "_bin"])
        .filter((F.col(pos) >= F.col("start")) & (F.col(pos) < F.col("end")))
        .withColumn("_at", F.col(pos) - F.col("start"))
        .drop("_bin")
    )


def _first_best(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the first minimum of ``values[lo:hi]`` for many ranges at once."""
    levels = [np.arange(len(values))]
    size = 1
    while size * 2 <= len(values):
        a, b = levels[-1][:-size], levels[-1][size:]
        levels.append(np.where(values[a] <= values[b], a, b))
        size *= 2
    out = np.full(len(lo), -1)
    some = np.flatnonzero(hi > lo)
    depth = np.floor(np.log2(hi[some] - lo[some])).astype(int)
    for d in np.unique(depth):
        rows = some[depth == d]
        a, b = levels[d][lo[rows]], levels[d][hi[rows] - (1 << d)]
        out[rows] = np.where(values[a] <= values[b], a, b)
    return out


def _cut_below(part: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Last frame below the limit in ``[lo, hi)``, else the first quietest one."""
    db = part["_db"].to_numpy()
    seen = np.maximum.accumulate(np.where(db < part["_limit"].iat[0], np.arange(len(db)), -1))
    last = seen[np.maximum(hi - 1, 0)]
    return np.where(last >= lo, last, _first_best(db, lo, hi))


def _cut_in_gap(part: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Middle of the first longest false run in ``[lo, hi)``, else the quietest frame."""
    voiced = part["_voiced"].to_numpy().astype(bool)
    db = part["_db"].to_numpy()
    off = np.concatenate([[False], ~voiced, [False]])
    first = np.flatnonzero(off[1:] & ~off[:-1])
    last = np.flatnonzero(~off[1:] & off[:-1])
    cut = _first_best(db, lo, hi)
    if not len(first):
        return cut
    a = np.searchsorted(last, lo, side="right")
    b = np.searchsorted(first, hi, side="left")
    some = np.flatnonzero(b > a)
    if not len(some):
        return cut
    a, b, lo, hi = a[some], b[some] - 1, lo[some], hi[some]
    start = np.maximum(first[a], lo)
    length = np.minimum(last[a], hi) - start
    inner = _first_best(first - last, a + 1, b)
    edge = np.minimum(last[b], hi) - first[b]
    for begin, size in ((first[inner], np.where(inner >= 0, (last - first)[inner], -1)), (first[b], np.where(b > a, edge, -1))):
        longer = size > length
        start, length = np.where(longer, begin, start), np.where(longer, size, length)
    cut[some] = start + length // 2
    return cut


def windowed_cuts(
    frames: DataFrame, series: Sequence[str], rate: int, hop: int, min_len: float, max_len: float,
    limit_db: float | None = None, voiced: str | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Cut long series so that every piece is between ``min_len`` and ``max_len`` seconds.

    ``frames`` holds ``frame``, ``rms`` and ``samples``; a series not longer than
    ``max_len`` is one piece.  With ``voiced`` the cut goes to the middle of the longest run
    of false frames in the window, else to the last frame below ``limit_db``;
    both fall back to the quietest frame.  A cut lies after the frame it follows:
    where the rule gives that frame itself, it is put to the rest of the window,
    and where no frame is left, the next one is the cut.  Returns
    ``(series, start, end)`` in samples.  The cut that follows a frame depends on
    the frames of one window only, so frames are worked in blocks that see one
    window ahead.
    """
    if hop / rate > max_len:
        raise ValueError(f"frames {hop} samples apart leave no place for a cut within {max_len} seconds")
    keys = list(series)
    ahead = ceil(max_len * rate / hop) + 2
    block = max(rows_per_block // 4, ahead)
    table = frames.select(
        *keys, "frame", "samples", decibels("rms").alias("_db"),
        (F.col(voiced) if voiced else F.lit(False)).alias("_voiced"),
        F.lit(float(limit_db) if limit_db is not None else float("-inf")).alias("_limit"),
    )
    own = F.floor(F.col("frame") / block)
    copies = F.when((F.col("frame") % block < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    table = table.withColumn("_part", F.explode(copies))
    choose = _cut_in_gap if voiced else _cut_below

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", ignore_index=True)
        n, at = int(pdf["samples"].iat[0]), pdf["frame"].to_numpy()
        total, base, count = n / rate, at[0], n // hop + 1
        now = at * hop / rate
        lo = (np.floor((now + min_len) * rate) // hop).astype(np.int64).clip(0, count - 1)
        hi = (np.floor((now + max_len) * rate) // hop).astype(np.int64).clip(0, count)
        going = (now + max_len < total) & ((at + 1) * hop < n) & (at < (pdf["_part"].iat[0] + 1) * block)
        at, lo, hi = at[going] - base, lo[going] - base, hi[going] - base
        cut = np.where(lo >= hi, hi, choose(pdf, lo, hi))
        stuck = np.flatnonzero(cut <= at)
        if len(stuck):
            rest, end = at[stuck] + 1, hi[stuck]
            cut[stuck] = np.where(rest >= end, rest, choose(pdf, rest, end))
        cut = cut + base
        out = pdf.loc[going, [*keys, "frame", "samples"]].copy()
        out["_cut"] = cut
        return out

    types = dict(table.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in [*keys, "frame", "samples"]) + ", _cut bigint"
    nodes = map_series(table, [*keys, "_part"], "frame", follow, shape).withColumn("_zero", F.lit(0))
    checked = with_blocks(frames.select(*keys, "frame"), keys, "frame", rows_per_block)
    nodes = with_blocks(nodes, keys, "frame", block_limit(checked, rows_per_block))
    chosen = greedy_chain(nodes, keys, "frame", "_cut", "_zero", span=float(ahead))
    # each chosen frame starts a piece that ends at its cut; the last cut starts the final piece
    chosen = Scan(chosen, keys, ["frame"]).lead("_more", "frame").columns()

    def sample(f: Column) -> Column:
        return F.floor(f * hop / F.lit(rate) * rate).cast("bigint")

    piece = F.struct(sample(F.col("frame")).alias("start"), sample(F.col("_cut")).alias("end"))
    tail = F.struct(sample(F.col("_cut")).alias("start"), F.col("samples").cast("bigint").alias("end"))
    pieces = F.when(F.col("_more").isNull(), F.array(piece, tail)).otherwise(F.array(piece))
    whole = frames.groupBy(*keys).agg(F.max("samples").cast("bigint").alias("end")).filter(F.col("end") / rate <= max_len)
    return chosen.select(*keys, F.inline(pieces)).unionByName(whole.select(*keys, F.lit(0).cast("bigint").alias("start"), "end"))


def nearest_flags(
    frames: DataFrame, flags: DataFrame, series: Sequence[str], time: Column, step: float, index: str, flag: str
) -> DataFrame:
    """Flag of the nearest position of a track with a fixed step, clipped to its ends."""
    keys = list(series)
    last = flags.groupBy(*keys).agg(F.max(index).alias("_last_index"))
    looked = salted_join(frames, last, keys, [c for c in frames.columns if c not in keys][:1]).withColumn(
        index, F.least(F.col("_last_index"), F.greatest(F.lit(0), F.rint(time / step))).cast("bigint")
    )
    return looked.join(flags.select(*keys, index, flag), [*keys, index]).drop("_last_index", index)


def merge_short(
    segments: DataFrame, series: Sequence[str], rate: int, min_len: float, max_len: float,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Merge neighbours until segments reach ``min_len`` where ``max_len`` allows it.

    A segment of at least ``min_len`` never takes in the next one, so the runs
    between such segments are independent; only the last segment of a series may
    be merged backwards, which keeps the last two runs together.
    """
    keys = list(series)
    rows = with_blocks(segments.select(*keys, "start", "end"), keys, "start", rows_per_block)
    long = (F.col("end") - F.col("start")) / rate >= min_len
    rows = Scan(rows, keys, ["start", "end"]).running_sum("_upto", long.cast("bigint")).total("_all", long.cast("bigint")).columns()
    run = F.col("_upto") - long.cast("bigint")
    rows = rows.select(
        *keys, "start", "end",
        F.least(run, F.greatest(F.col("_all") - 1, F.lit(0))).alias("_run"),
        (run >= F.col("_all") - 1).alias("_tail"),
    )

    # lengths in samples that are long enough, and that are still allowed
    enough, most = ceil(min_len * rate), floor(max_len * rate)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "end"], ignore_index=True)
        begin, end = pdf["start"].to_numpy(), pdf["end"].cummax().to_numpy()
        # what follows a piece depends on its first row: the row after it is long enough, or the one that makes it too long
        after = np.minimum(np.searchsorted(end, begin + enough) + 1, np.searchsorted(end, begin + most, side="right"))
        after = np.maximum(after, np.arange(1, len(end) + 1))
        heads = [0]
        while (following := int(after[heads[-1]])) < len(end):
            heads.append(following)
        # a last piece that is far too short goes back into the piece before
        while pdf["_tail"].iat[-1] and len(heads) > 1 and (end[-1] - begin[heads[-1]]) / rate < min_len - 2.0 and end[-1] - begin[heads[-2]] <= most:
            heads.pop()
        out = pd.DataFrame({c: pdf[c].iat[0] for c in keys}, index=range(len(heads)))
        return out.assign(start=begin[heads], end=end[np.array([*heads[1:], len(end)]) - 1])[[*keys, "start", "end"]]

    shape = rows.select(*keys, "start", "end").schema
    return map_series(rows, [*keys, "_run"], "start", settle, shape)


def length_statistics(segments: DataFrame, series: Sequence[str], rate: float) -> DataFrame:
    """Count, minimum, maximum and average length in seconds."""
    d = (F.col("end") - F.col("start")) / rate
    return segments.groupBy(*series).agg(
        F.count(F.lit(1)).alias("segments"), F.min(d).alias("min_len"), F.max(d).alias("max_len"), F.avg(d).alias("avg_len")
    )


def segmentation_score(
    segments: DataFrame, lengths: DataFrame, series: Sequence[str], rate: float, min_len: float, max_len: float
) -> DataFrame:
    """How far segments are from the wanted lengths and count; lower is better.

    ``lengths`` holds ``samples`` per series.
    """
    d = (F.col("end") - F.col("start")) / rate
    misfit = F.when(d < min_len, (min_len - d) * 1.5).when(d > max_len, d - max_len).otherwise(0.0)
    per = segments.groupBy(*series).agg(F.sum(misfit).alias("_misfit"), F.count(F.lit(1)).alias("segments"))
    expected = F.col("samples") / rate / ((min_len + max_len) / 2)
    return per.join(lengths, list(series)).select(
        *series, "segments", (F.col("_misfit") + F.abs(F.col("segments") - expected) * 0.5).alias("score")
    )


__all__ = [
    "BLOCK", "cut_at_silences", "decibels", "hopping_rms", "length_statistics", "merge_short", "mix_channels", "nearest_flags",
    "segment_samples", "segmentation_score", "silence_parameters", "silence_segments", "silences", "windowed_cuts",
]
