"""Pitch numbers, names and deviations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.grid import _c

# Note names of one octave.
NOTE_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def clamp_pitch(pitch) -> Column:
    """Nearest whole pitch number within 0..127, half to even."""
    return F.least(F.lit(127), F.greatest(F.lit(0), F.rint(_c(pitch)))).cast("int")


def pitch_name(pitch, cents: bool = False) -> Column:
    """``60 -> C4``; with cents ``60.25 -> C4+25``."""
    p = _c(pitch)
    whole = F.rint(p).cast("int")
    names = F.array(*[F.lit(n) for n in NOTE_NAMES])
    name = F.concat(
        F.element_at(names, F.pmod(whole, F.lit(12)) + 1), ((whole / 12).cast("int") - 1).cast("string")
    )
    if not cents:
        return name
    rest = (F.rint((p - whole) * 100) / 100 * 100).cast("int")
    return F.concat(name, F.format_string("%+d", rest))


def pitch_from_name(name) -> Column:
    """Inverse of ``pitch_name``; NULL for anything that is not a note name."""
    n = _c(name)
    letter = F.regexp_extract(n, r"^([A-G]#?)(-?\d+)([+-]\d+)?$", 1)
    octave = F.regexp_extract(n, r"^([A-G]#?)(-?\d+)([+-]\d+)?$", 2)
    rest = F.regexp_extract(n, r"^([A-G]#?)(-?\d+)([+-]\d+)?$", 3)
    index = F.array_position(F.array(*[F.lit(x) for x in NOTE_NAMES]), letter) - 1
    return F.when(
        letter != "",
        12.0 * (octave.cast("int") + 1) + index + F.coalesce(F.nullif(rest, F.lit("")).cast("int"), F.lit(0)) * 0.01,
    )


def cents(value, reference, limit: int = 1200) -> Column:
    """Deviation in hundredths of a semitone, clipped to ``limit``."""
    d = (_c(value) - _c(reference)) * 100.0
    return F.rint(F.least(F.lit(limit), F.greatest(F.lit(-limit), d))).cast("int")


def semitone(frequency) -> Column:
    """Frequency in Hz to pitch number; NULL where there is none."""
    f = _c(frequency)
    return F.when((f > 0) & ~F.isnan(f), 69.0 + 12.0 * F.log2(f / 440.0))
