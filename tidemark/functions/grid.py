"""Time grids: ticks, snapping, candidate lattices and step-shaped penalties."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One beat is 480 ticks; the tick rate is tempo * 8 per second.
BEAT_TICKS = 480
TICKS_PER_TEMPO = 8
# Preferred multiples by the largest ratio they serve.
PREFERRED_MULTIPLES = ((1.5, 1), (2.625, 2), (3.375, 3), (4.625, 4), (5.625, 5), (7.0, 6))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ticks(seconds, tempo) -> Column:
    """Seconds to ticks, half to even."""
    return F.rint(_c(seconds) * _c(tempo) * TICKS_PER_TEMPO).cast("bigint")


def seconds(tick, tempo) -> Column:
    return _c(tick) / (_c(tempo) * TICKS_PER_TEMPO)


def snap(tick, step) -> Column:
    """Nearest multiple of ``step``, half to even."""
    return (F.rint(_c(tick) / _c(step)) * _c(step)).cast("bigint")


def grid_distance(x, step) -> Column:
    """Distance from ``x`` to the nearest multiple of ``step``."""
    r = F.pmod(_c(x), _c(step))
    return F.least(r, _c(step) - r)


def circular_distance(a, b, modulo) -> Column:
    d = F.abs(_c(a) - _c(b)) % _c(modulo)
    return F.least(d, _c(modulo) - d)


def nearest_candidate(value, candidates: Column) -> Column:
    """Array element nearest to ``value``; the earliest one on a tie."""
    scored = F.transform(
        candidates,
        lambda c, i: F.struct(F.abs(c - _c(value)).alias("d"), i.alias("i"), c.alias("c")),
    )
    return F.array_min(scored).getField("c")


def candidate_values(tick, step, radius: int = 3) -> Column:
    """Sorted grid points within ``radius`` steps of the nearest grid point."""
    centre = F.rint(_c(tick) / _c(step)).cast("bigint")
    return F.transform(F.sequence(centre - radius, centre + radius), lambda k: k * _c(step).cast("bigint"))


def candidate_pairs(start, end, step, radius: int = 3) -> Column:
    """Sorted distinct ``struct(s, e)`` pairs of start and end candidates with ``e > s``."""
    ends = candidate_values(end, step, radius)
    pairs = F.flatten(
        F.transform(
            candidate_values(start, step, radius),
            lambda s: F.transform(F.filter(ends, lambda e: e > s), lambda e: F.struct(s.alias("s"), e.alias("e"))),
        )
    )
    return F.array_sort(F.array_distinct(pairs))


def shift_limit(step, factor: float, floor: int, cap: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(floor), F.rint(_c(step) * factor))).cast("bigint")


def position_penalty(tick, step) -> Column:
    """Cost of a start by how strong its place in the beat is."""
    pos, s = F.pmod(_c(tick), F.lit(BEAT_TICKS)), _c(step)
    return (
        F.when(pos == 0, F.lit(0.0))
        .when(pos % 240 == 0, s * 0.04)
        .when(pos % 120 == 0, s * 0.1)
        .when((s <= 60) & (pos % 60 == 0), s * 0.2)
        .when((s <= 30) & (pos % 30 == 0), s * 0.3)
        .otherwise(s * 0.42)
    )


def length_penalty(duration, step) -> Column:
    """Cost of a duration by how common its multiple of ``step`` is."""
    s = _c(step)
    multiple = F.greatest(F.lit(1), F.rint(_c(duration) / F.greatest(s, F.lit(1))).cast("bigint"))
    return (
        F.when(multiple.isin(1, 2, 4, 8, 16, 32), F.lit(0.0))
        .when(multiple.isin(3, 6, 12, 24), s * 0.05)
        .otherwise(s * 0.16)
    )


def preferred_length(duration, step) -> Column:
    """Duration a raw length leans to; NULL for very short ones."""
    d, s = _c(duration), _c(step)
    ratio = d / F.greatest(s, F.lit(1))
    choice = F.when(d <= F.greatest(F.lit(1), F.rint(s * 0.375)), F.lit(None).cast("bigint"))
    for upper, multiple in PREFERRED_MULTIPLES:
        choice = choice.when(ratio <= upper, (s * multiple).cast("bigint"))
    return choice.otherwise(F.greatest(s.cast("bigint"), (F.rint(ratio) * s).cast("bigint")))


def should_snap(mode, step) -> Column:
    """Whether a snap mode does anything at all for the given step."""
    m = F.lower(F.coalesce(F.nullif(_c(mode), F.lit("")), F.lit("simple")))
    return (m == "dp") | (_c(step) > 0)


def frame_to_seconds(frame, frame_length, edge_difference=None) -> Column:
    """Frame index to seconds, with an edge correction of at most half a frame."""
    shift = F.lit(0.0)
    if edge_difference is not None:
        shift = F.least(F.lit(0.5), F.greatest(F.lit(-0.5), _c(edge_difference) / 2))
    return F.greatest(F.lit(0.0), _c(frame_length) * (_c(frame) + shift))


def seconds_to_frame(time, rate, hop) -> Column:
    return F.floor(F.floor(_c(time) * _c(rate)) / _c(hop)).cast("bigint")


def time_schedule(start, n: int) -> Column:
    """``n`` evenly spaced points from ``start`` towards 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: _c(start) + i * (1 - _c(start)) / n)
