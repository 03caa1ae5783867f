"""One timeline from repeated labellings of the same recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import agreeing_runs, trimmed_mean, trimmed_mean_of
from tidemark.operators.intervals import close_small_gaps, fill_complement
from tidemark.scan import ROWS_PER_BLOCK, Scan, with_blocks
from tidemark.session import stage

# Fixed value: shortest interval of the rebuilt timeline.
MIN_STEP = 1e-4


def rebuild_increasing(
    df: DataFrame, series: Sequence[str], index: str, start: str, end: str, step: float = MIN_STEP,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Move starts to the end before and ends to at least ``step`` after the start."""
    rows = Scan(with_blocks(df, series, index, rows_per_block), series, [index]).row_number("_n").columns()
    least = F.greatest(F.col(end), F.col(start) + step) - F.col("_n") * step
    rows = Scan(rows, series, [index]).running_max("_m", least).columns()
    rows = rows.withColumn("_end", F.col("_n") * step + F.greatest(F.lit(0.0), F.col("_m")))
    rows = Scan(rows, series, [index]).lag("_before", "_end").columns()
    new = {start: F.greatest(F.col(start), F.coalesce("_before", F.lit(0.0))), end: F.col("_end")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


#: Runs of a group up to which the times of one place are averaged as a short array.
MOST_RUNS = 10_000


def consensus_timeline(
    runs: DataFrame, group: Sequence[str], length: DataFrame, gap: float = 0.1, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Consensus of ``(group, run, idx, start, end, label)``: ``(group, start, end, label)``.

    Keeps the runs with the most frequent label sequence, averages each boundary
    without outliers, and fills small and large gaps up to ``length``.
    """
    keys = list(group)
    winners = stage(agreeing_runs(runs, keys, "run", "idx", "label", rows_per_block))
    most_runs, most_points = winners.agg(F.max("votes"), F.max("points")).first()
    # known from the vote: where no timeline is large, no later step has to count
    limit = None if (most_points or 0) <= rows_per_block else rows_per_block
    kept = runs.join(winners.select(*keys, "run"), [*keys, "run"])
    place = [*keys, "idx"]
    if (most_runs or 0) <= MOST_RUNS:
        times = kept.groupBy(*place).agg(
            *[F.collect_list(F.col(c).cast("double")).alias(f"_{c}") for c in ("start", "end")], F.first("label").alias("label")
        )
        timeline = times.select(*place, trimmed_mean_of(F.col("_start")).alias("start"), trimmed_mean_of(F.col("_end")).alias("end"), "label")
    else:
        starts = trimmed_mean(kept, place, "start", name="start", rows_per_block=rows_per_block).select(*place, "start")
        ends = trimmed_mean(kept, place, "end", name="end", rows_per_block=rows_per_block).select(*place, "end")
        timeline = starts.join(ends, place).join(kept.groupBy(*place).agg(F.first("label").alias("label")), place)
    timeline = rebuild_increasing(stage(timeline), keys, "idx", "start", "end", rows_per_block=limit)
    timeline = timeline.join(length.select(*keys, "length"), keys)
    closed = close_small_gaps(timeline, keys, ["idx"], "start", "end", "length", gap, limit)
    return fill_complement(closed, keys, ["idx"], "start", "end", "label", "length", rows_per_block=limit)
