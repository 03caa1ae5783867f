"""Pitch curves: deviation of a sampled track from the notes it belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import grid as G
from tidemark.functions.pitch import cents
from tidemark.operators.intervals import away_from_edges, points_in_intervals
from tidemark.operators.series import despike, fill_short_gaps, moving_upper_median
from tidemark.scan import ROWS_PER_BLOCK, block_limit, with_blocks
from tidemark.session import stage

# Distance of curve points in ticks, and missing points that are filled.
CURVE_STEP, MOST_STEPS = 5, 12


def pitch_curve(
    track: DataFrame, notes: DataFrame, keys: Sequence[str], step: float, tempo: float, width: float,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Smoothed curve points ``(keys, x, y)``.

    ``track`` holds ``frame, pitch`` at ``step`` seconds, NULL where there is no
    pitch; ``notes`` holds ``idx, onset, offset, note_pitch``.  Smoothing stays
    inside the points of one note.
    """
    keys = list(keys)
    points = track.select(*keys, "frame", "pitch", (F.col("frame") * step).alias("t"))
    hit = points_in_intervals(points, notes, keys, "t", ("onset", "offset"), "idx", width)
    voiced = F.col("pitch").isNotNull() & ~F.isnan("pitch") & away_from_edges("t", "onset", "offset")
    hit = hit.filter(voiced).select(
        *keys, "idx", "frame", G.snap(G.ticks("t", tempo), CURVE_STEP).alias("x"),
        cents("pitch", "note_pitch").cast("bigint").alias("y"),
    )
    run = [*keys, "idx"]
    single = stage(hit.groupBy(*run, "x").agg(F.max_by("y", "frame").alias("y")))
    # rows are counted once, before gaps are filled; the blocks bound what filling makes of them
    single = with_blocks(single, run, "x", max(1, rows_per_block // (MOST_STEPS + 1)))
    limit = block_limit(single, rows_per_block)
    filled = fill_short_gaps(single, run, "x", "y", CURVE_STEP, MOST_STEPS, rows_per_block=limit)
    calm = moving_upper_median(filled, run, ["x"], "y", name="_y", rows_per_block=limit)
    smooth = despike(calm.drop("y"), run, ["x"], "_y", name="_z", rows_per_block=limit)
    return smooth.groupBy(*keys, "x").agg(F.max_by("_z", "idx").alias("y"))
