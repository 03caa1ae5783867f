"""Watermarked windows over live series.

Rows later than the watermark are dropped; the number shows in the progress of
the query (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checks import log_level, log_percent


def gap_sessions(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, gap: str, delay: str
) -> DataFrame:
    """Closed sessions of each series: ``(keys, start, last, n, energy)``.

    ``start`` and ``last`` are the first and last row times.  Filter on those
    only: a filter on the bounds of the window would run before sessions merge.
    """
    v = F.col(value).cast("double")
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, gap).alias("_w"))
        .agg(
            F.min(time).alias("start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"),
            F.sqrt(F.avg(v * v)).alias("energy"),
        )
        .drop("_w")
    )


def hopping_energy(
    stream: DataFrame, keys: Sequence[str], time: str, value: str, size: str, hop: str, delay: str
) -> DataFrame:
    """Root mean square per sliding window: ``(keys, window_start, n, rms)``."""
    v = F.col(value).cast("double")
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, size, hop).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(v * v)).alias("rms"))
        .select(*keys, F.col("_w.start").alias("window_start"), "n", "rms")
    )


def log_lines(stream: DataFrame, text: str) -> DataFrame:
    """One row per non-blank line of a text column with its level and percentage."""
    others = [c for c in stream.columns if c != text]
    lines = stream.select(*others, F.posexplode(F.split(text, "[\\r\\n]")).alias("line_no", "_line"))
    line = F.trim("_line")
    return lines.filter(line != "").select(
        *others, "line_no", line.alias("line"), log_level(line).alias("level"), log_percent(line).alias("percent")
    )
