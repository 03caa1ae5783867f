"""Whole segmentations of sample series, and the search for good parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checks import METHOD_ALIASES, check_bounds
from tidemark.operators import segments as S
from tidemark.operators.islands import merge_tiny
from tidemark.scan import ROWS_PER_BLOCK
from tidemark.session import stage

# The parameter grid and the defaults of each method.
GRID_THRESHOLDS = (-45, -40, -35, -30, -25, -20)
GRID_MIN_LENGTHS_MS = (8000, 6000, 4000, 2500, 1500)
FRAME_LENGTH, HOP = 2048, 512
TINY = 0.35


def silence_plan(
    samples: DataFrame, series: Sequence[str], pos: str, value: str, rate: int, rows_per_block: int = ROWS_PER_BLOCK,
    **milliseconds,
) -> DataFrame:
    """Energy per hop, then the silence split; ``milliseconds`` as in ``silence_parameters``."""
    p = S.silence_parameters(rate, **milliseconds)
    frames = stage(S.hopping_rms(samples, series, pos, value, p["frame_length"], p["hop"]))
    return S.silence_segments(
        frames, series, p["hop"], p["threshold"], p["min_length"], p["min_interval"], p["max_kept"], rows_per_block
    )


def window_hop(rate: int, min_len: float, max_len: float, by_flags: bool = False) -> int:
    """Samples from frame to frame when long segments are cut: ``HOP``, or fewer where its frames are too far apart.

    With ``HOP`` a window that holds no frame after the one it is seen from leaves nothing to choose (by flags, a window
    beyond one hop is then cut at its end).  Frames are then those of the silence split, none longer than a window.
    """
    low, high = int(min_len * rate), int(max_len * rate)
    if high // HOP > max(low // HOP, 1) or (by_flags and low >= HOP):
        return HOP
    return min(HOP, S.silence_parameters(rate)["hop"], (high - low) // (FRAME_LENGTH // HOP) or max(1, high))


def three_stage(
    samples: DataFrame, series: Sequence[str], pos: str, value: str, rate: int, min_len: float = 8.0, max_len: float = 22.0,
    silence_db: float = -40.0, min_silence_ms: int = 800, split_db: float = -30.0, tiny: float = TINY,
    voiced: DataFrame | None = None, voiced_step: float | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Strip silence, split long segments, merge short ones.

    With ``voiced`` (``series, index, voiced`` at ``voiced_step`` seconds) long
    segments are cut in their longest unvoiced stretch instead of by energy.
    """
    keys = list(series)
    stripped = silence_plan(
        samples, keys, pos, value, rate, rows_per_block,
        threshold_db=silence_db, min_length_ms=min_silence_ms, min_interval_ms=200, max_kept_ms=100,
    )
    stripped = stage(stripped)
    long = (F.col("end") - F.col("start")) / rate > max_len
    part = [*keys, "start"]
    inside = S.segment_samples(samples, stripped.filter(long), keys, pos, width=max(1, int(max_len * rate)))
    hop = window_hop(rate, min_len, max_len, voiced is not None)
    frames = S.hopping_rms(inside, part, "_at", value, FRAME_LENGTH // HOP * hop, hop)
    if voiced is not None:
        time = F.col("frame") * (hop / rate) + F.col("start") / rate
        frames = S.nearest_flags(frames, voiced, keys, time, voiced_step, "index", "voiced")
    frames = stage(frames)
    cuts = S.windowed_cuts(
        frames.withColumnRenamed("start", "_segment"), [*keys, "_segment"], rate, hop, min_len, max_len,
        limit_db=split_db, voiced="voiced" if voiced is not None else None, rows_per_block=rows_per_block,
    ).select(*keys, (F.col("_segment") + F.col("start")).alias("start"), (F.col("_segment") + F.col("end")).alias("end"))
    pieces = stage(stripped.filter(~long).select(*keys, "start", "end").unionByName(cuts))
    whole = merge_tiny(pieces, keys, "start", "end", tiny * rate, rows_per_block)
    return S.merge_short(whole, keys, rate, min_len, max_len, rows_per_block)


def grid_search(
    samples: DataFrame, series: Sequence[str], pos: str, value: str, rate: int, min_len: float = 4.0, max_len: float = 20.0,
    min_interval_ms: int = 200, max_kept_ms: int = 500, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Silence split with the best scoring parameters of a fixed grid, per series.

    Silences are found in one pass over the frames for all thresholds; the
    lengths of the grid are tried on silences alone.  Of equal scores, to nine
    places, the first setting counts.  Adds the chosen ``threshold_db``,
    ``min_length_ms`` and the ``score``.
    """
    keys, part = list(series), [*series, "setting"]
    p = S.silence_parameters(rate, -30.0, 8000, min_interval_ms, 20, max_kept_ms)
    frames = stage(S.hopping_rms(samples, keys, pos, value, p["frame_length"], p["hop"]))
    found = stage(S.silences(frames, keys, [10 ** (t / 20.0) for t in GRID_THRESHOLDS], p["min_interval"], p["max_kept"], rows_per_block))
    count = len(GRID_MIN_LENGTHS_MS)
    least = [round(rate * m / 1000 / p["hop"]) for m in GRID_MIN_LENGTHS_MS]
    tried = F.array(*[F.struct(F.lit(j).alias("_length"), F.lit(m).alias("_min")) for j, m in enumerate(least)])

    def with_settings(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.inline(tried))
        return rows.withColumn("setting", F.col("level") * count + F.col("_length")).drop("level", "_length")

    levels = F.explode(F.sequence(F.lit(0), F.lit(len(GRID_THRESHOLDS) - 1))).alias("level")
    heads = with_settings(frames.filter(F.col("frame") == 0).select(*keys, "samples", levels))
    pieces = stage(S.cut_at_silences(with_settings(found), heads, part, p["hop"], max(least)))
    scores = S.segmentation_score(pieces, heads.select(*part, "samples"), part, rate, min_len, max_len)
    best = scores.withColumn("score", F.round("score", 9)).groupBy(*keys).agg(F.min(F.struct("score", "setting")).alias("_best"))
    best = best.select(*keys, F.col("_best.setting").alias("setting"), F.col("_best.score").alias("score"))
    level, length = F.floor(F.col("setting") / count).cast("int"), (F.col("setting") % count).cast("int")
    named = best.select(
        *part, "score", F.get(F.array(*map(F.lit, GRID_THRESHOLDS)), level).alias("threshold_db"),
        F.get(F.array(*map(F.lit, GRID_MIN_LENGTHS_MS)), length).alias("min_length_ms"),
    )
    return pieces.join(named, part).select(*keys, "start", "end", "threshold_db", "min_length_ms", "score")


def segment_series(
    samples: DataFrame, series: Sequence[str], pos: str, value: str, rate: int, method: str = "default",
    min_len: float | None = None, max_len: float | None = None, rows_per_block: int = ROWS_PER_BLOCK, **options,
) -> DataFrame:
    """Segment by method name: default, heuristic, smart or grid."""
    if method not in METHOD_ALIASES:
        raise ValueError(f"Unsupported slicing method: {method!r}")
    name = METHOD_ALIASES[method]
    bounds = check_bounds(min_len, max_len)
    if bounds and name != "default":
        options.update(min_len=bounds[0], max_len=bounds[1])
    if name == "default":
        return silence_plan(
            samples, series, pos, value, rate, rows_per_block, threshold_db=-30.0, min_length_ms=5000, max_kept_ms=500
        )
    if name == "grid":
        return grid_search(samples, series, pos, value, rate, rows_per_block=rows_per_block, **options)
    if name == "smart" and "voiced" not in options:
        raise ValueError("the smart method needs a voiced track")
    return three_stage(samples, series, pos, value, rate, rows_per_block=rows_per_block, **options)
