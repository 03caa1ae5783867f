"""Gaps and islands over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.chain import greedy_chain
from tidemark.fold import Fold, Ride
from tidemark.functions.grid import _c
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, with_blocks
from tidemark.session import stage


def previous_gap(
    df: DataFrame, series: Sequence[str], start: str, end: str, order: Sequence[str], name: str = "gap",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Distance to the end of the row before, at least 0; 0 for the first row."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    out = Scan(rows, series, order).lag("_previous", end).columns()
    gap = F.greatest(F.col(start) - F.col("_previous"), F.lit(0).cast(df.schema[start].dataType))
    zero = F.lit(0).cast(df.schema[start].dataType)
    return out.select(*df.columns, F.when(F.col("_previous").isNull(), zero).otherwise(gap).alias(name))


def gap_or_cap_segments(
    df: DataFrame, series: Sequence[str], start: str, end: str, order: Sequence[str], gap: float, cap: int,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the segments of a series: a new one on a gap of ``gap`` or after ``cap`` rows.

    Adds ``seg_id``, counted from 0, and ``row_in_seg``.
    """
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_previous", end).row_number("_row").columns()
    rows = rows.withColumn("_new", F.col("_previous").isNull() | (F.col(start) - F.col("_previous") >= gap))
    rows = Scan(rows, series, order).last_valid("_first", F.when(F.col("_new"), F.col("_row"))).columns()
    place = F.col("_row") - F.col("_first")
    rows = rows.withColumn("row_in_seg", (place % cap).cast("int"))
    return (
        Scan(rows, series, order)
        .running_sum("_seg", (F.col("row_in_seg") == 0).cast("bigint"))
        .columns()
        .select(*df.columns, (F.col("_seg") - 1).alias("seg_id"), "row_in_seg")
    )


def tied_phrases(
    df: DataFrame, series: Sequence[str], start: str, end: str, label: str, order: Sequence[str], step: int,
    cap: int = 16, tie: str = "-", rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Phrases of an interval series; adds ``seg_id``.

    A phrase ends at a gap of ``step`` (at least 30), at any positive gap where
    neither side is a tie, and after ``cap`` rows at the first row that does not
    overlap the one before.
    """
    limit = max(step, 30)
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_end", end).lag("_label", label).row_number("_row").columns()
    gap = F.col(start) - F.col("_end")
    loose = (gap > 0) & ~F.coalesce(F.col("_label") == tie, F.lit(False)) & ~F.coalesce(_c(label) == tie, F.lit(False))
    rows = rows.select(
        "*",
        (F.col("_end").isNull() | (gap >= limit) | loose).alias("_hard"),
        F.coalesce(gap >= 0, F.lit(True)).alias("_open"),
    )
    rows = Scan(rows, series, order).last_valid("_first", F.when(F.col("_hard"), F.col("_row"))).columns()
    # the first row of an island starts a phrase; only rows beyond the cap need the chain
    rows = rows.withColumn("_root", F.col("_first") + cap)
    nodes = rows.filter(F.col("_open") & (F.col("_row") >= F.col("_root"))).select(
        *series, *([BLOCK] if BLOCK in rows.columns else []), "_first", "_root", "_row",
        (F.col("_row") + cap).alias("_reach"),
    )
    starts = greedy_chain(nodes, [*series, "_first"], "_row", "_reach", "_root", span=cap).select(
        *series, "_row", F.lit(1).alias("_start")
    )
    marked = rows.join(starts, [*series, "_row"], "left")
    return (
        Scan(marked, series, order)
        .running_sum("_seg", (F.col("_hard") | F.col("_start").isNotNull()).cast("bigint"))
        .columns()
        .select(*df.columns, (F.col("_seg") - 1).alias("seg_id"))
    )


def merge_tiny(
    segments: DataFrame, series: Sequence[str], start: str, end: str, tiny: float,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Merge segments shorter than ``tiny`` into the one before, leading ones into the next.

    The gap between merged segments stays inside the result.
    """
    rows = with_blocks(segments.select(*series, start, end), series, start, rows_per_block)
    large = (F.col(end) - F.col(start) >= tiny).cast("bigint")
    rows = Scan(rows, series, [start, end]).running_sum("_large", large).columns()
    return (
        rows.groupBy(*series, F.greatest(F.col("_large"), F.lit(1)).alias("seg_id"))
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("parts"))
        .withColumn("seg_id", F.col("seg_id") - 1)
    )


def merge_equal_flags(
    df: DataFrame, series: Sequence[str], order: Sequence[str], flag: str, duration: str, merged: Column | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Merge runs of rows with an equal flag, adding their durations.

    ``merged`` limits merging to flags that fulfil it, e.g. ``F.col("flag") == 0``.
    """
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_before", F.struct(F.col(flag).alias("f"))).columns()
    same = F.col("_before").isNotNull() & F.col("_before.f").eqNullSafe(F.col(flag))
    if merged is not None:
        same = same & merged
    rows = Scan(rows.withColumn("_new", (~same).cast("bigint")), series, order).running_sum("_run", "_new").columns()
    return rows.groupBy(*series, (F.col("_run") - 1).alias("run_id")).agg(
        F.first(flag).alias(flag), F.sum(duration).alias(duration), F.count(F.lit(1)).alias("rows")
    )


def threshold_runs(
    df: DataFrame, series: Sequence[str], index: str, value: str, threshold: float, max_gap: int = 5, min_length: int = 10,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Runs of rows at or above ``threshold`` that may hold up to ``max_gap`` misses in a row.

    ``index`` counts the rows of a series from 0.  A run that is still open at
    the end of its series reaches to the last row.
    """
    lengths = df.groupBy(*series).agg(F.max(index).alias("_last"))
    active = df.filter(F.col(value) >= threshold).select(*series, index)
    rows = with_blocks(active, series, index, rows_per_block)
    rows = Scan(rows, series, [index]).lag("_before", index).columns()
    new = F.coalesce(F.col(index) - F.col("_before") > max_gap + 1, F.lit(True)).cast("bigint")
    rows = Scan(rows.withColumn("_new", new), series, [index]).running_sum("_run", "_new").columns()
    runs = rows.groupBy(*series, "_run").agg(F.min(index).alias("first"), F.max(index).alias("_end"))
    runs = runs.join(lengths, list(series))
    open_end = F.col("_last") - F.col("_end") <= max_gap
    last = F.when(open_end, F.col("_last")).otherwise(F.col("_end"))
    long_enough = F.when(open_end, F.col("_last") + 1 - F.col("first") >= min_length).otherwise(
        (F.col("_end") > F.col("first")) & (F.col("_end") - F.col("first") >= min_length)
    )
    return runs.filter(long_enough).select(*series, "first", last.alias("last"))


def collapse_repeats(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, blank=None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Keep the first row of every run of equal values, then drop blanks."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_before", F.struct(F.col(value).alias("v"))).columns()
    kept = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))
    if blank is not None:
        kept = kept & (F.col(value) != blank)
    return rows.filter(kept).select(*df.columns)


def degenerate_rows(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, window: int = 15, max_distinct: int = 3,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Rows at which the last ``window`` values are at most ``max_distinct`` different ones.

    Only rows after the first ``window`` count.
    """
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).history("_seen", value, window - 1).row_number("_row").columns()
    distinct = F.size(F.array_distinct(F.concat("_seen", F.array(F.col(value)))))
    return rows.filter((F.col("_row") > window) & (distinct <= max_distinct)).select(
        *df.columns, F.col("_row").alias("row_number"), distinct.alias("distinct_values")
    )


def degenerate_places(tokens: str, window: int = 15, max_distinct: int = 3) -> Column:
    """Row numbers, from 1, that ``degenerate_rows`` gives for a sequence held as an array; for sequences that fit one row.

    ``tokens`` must be a column that is there already, as it is looked at for every place.
    """
    n = F.size(tokens)
    places = F.when(n > window, F.sequence(F.lit(window + 1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda r: F.size(F.array_distinct(F.slice(tokens, r - window + 1, window))) <= max_distinct)


def running_boundaries(
    df: DataFrame, series: Sequence[str], order: Sequence[str], duration: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Start and end of consecutive intervals from their durations."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).running_sum("end", duration).columns()
    return rows.select(*df.columns, (F.col("end") - F.col(duration)).alias("start"), "end")


def number_batches(
    df: DataFrame, series: Sequence[str], order: Sequence[str], size: int, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Number fixed-size batches of rows in order, from 0."""
    if size <= 0:
        raise ValueError("batch size must be greater than 0")
    rows = Scan(with_blocks(df, series, order[0], rows_per_block), series, order).row_number("_row").columns()
    return rows.select(*df.columns, F.floor((F.col("_row") - 1) / size).alias("batch"))


def anchored_runs(
    df: DataFrame, series: Sequence[str], start: str, end: str, value: str, label: str, order: Sequence[str],
    max_gap: float = 0.01, tolerance: float = 0.1, continuation: str = "-", rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Merge touching continuation rows whose value stays near the first row of the run.

    A run ends at gaps, at rows that carry a label of their own and at rows whose
    value leaves the run's first one; the first value is carried over blocks.
    """
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).lag("_end", end).columns()
    cut = F.col("_end").isNull() | (F.abs(F.col("_end") - F.col(start)) >= max_gap) | (F.col(label) != continuation)
    rows = rows.withColumns({"_cut": cut, "_value": F.col(value).cast("double")})
    limit = block_limit(rows, rows_per_block)
    based = Fold(_Anchor(tolerance), series, order, ["_value"], "_cut").states(rows, "_base", limit)
    based = based if limit is None else stage(based)
    based = Scan(based, series, order).lag("_before", "_base").columns()
    new = F.col("_cut") | ~(F.abs(F.col("_before") - F.col("_value")) < tolerance)
    based = Scan(based.withColumn("_new", new.cast("bigint")), series, order).running_sum("_part", "_new").columns()
    place = F.struct(*order)
    return based.groupBy(*series, "_part").agg(
        F.min(start).alias(start),
        F.max_by(end, place).alias(end),
        F.min_by(value, place).alias(value),
        F.min_by(label, place).alias(label),
        F.count(F.lit(1)).alias("rows"),
    ).drop("_part")


class _Anchor(Ride):
    """The first value of a run, until a value is ``tolerance`` or more off."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def fresh(self, value):
        return value

    def next(self, state, value):
        return state if abs(state - value) < self.tolerance else value

    def limits(self, value):
        return value - self.tolerance, value + self.tolerance

    def sides(self, states, value):
        return np.where(np.abs(states - value) < self.tolerance, 0, np.where(states < value, -1, 1))

    def broken(self, side, value):
        return value
