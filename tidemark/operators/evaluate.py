"""Comparing predicted and target sequences, and robust summaries of repeats."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grid import _c
from tidemark.operators.align import BLOCK_SIDE, COMMON, BlockAlignment, Costs, codes, cut_series
from tidemark.operators.align import path as aligned_path
from tidemark.operators.intervals import overlap_join
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, exact_median, salted_join, with_blocks
from tidemark.session import stage


def tier_intervals(
    points: DataFrame, series: Sequence[str], index: str, time: str, mark: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Intervals from each point to the next one: ``(series, mark, start, end)``."""
    rows = with_blocks(points, series, index, rows_per_block)
    rows = Scan(rows, series, [index]).lead("_end", time).columns().filter(F.col("_end").isNotNull())
    return rows.select(*series, F.col(mark).alias("mark"), F.col(time).alias("start"), F.col("_end").alias("end"))


def interval_iou(
    predicted: DataFrame, target: DataFrame, series: Sequence[str], width: float, levels: int = 1
) -> DataFrame:
    """Intersection over union per label over all series.

    Both sides hold ``mark, start, end``, sorted and free of overlaps within a
    series.  A label on one side only scores 0.
    """
    keys = [*series, "mark"]
    both = predicted.select("mark", "start", "end").unionByName(target.select("mark", "start", "end"))
    total = both.groupBy("mark").agg(F.sum(F.col("end") - F.col("start")).alias("_sum"))
    t = target.select(*keys, F.col("start").alias("_ts"), F.col("end").alias("_te"))
    pairs = overlap_join(predicted.select(*keys, "start", "end"), t, keys, ("start", "end"), ("_ts", "_te"), width, levels)
    common = pairs.groupBy("mark").agg(F.sum(F.least("end", "_te") - F.greatest("start", "_ts")).alias("_common"))
    shared = F.coalesce("_common", F.lit(0.0))
    union = F.col("_sum") - shared
    return total.join(common, "mark", "left").select(
        "mark", shared.alias("intersection"), union.alias("union"),
        F.when(union == 0, F.lit(0.0)).otherwise(F.round(shared / union, 6)).alias("iou"),
    )


def _edit_cost(pred: pd.DataFrame, target: pd.DataFrame, low: float, high: float) -> int:
    """Labelling effort: inserting costs 2 at a label change, moving 1 within ``[low, high)``."""
    n = min(len(pred), len(target))
    pt, pm = pred["time"].to_numpy()[:n], pred["mark"].to_numpy()[:n]
    tt, tm = target["time"].to_numpy()[:n], target["mark"].to_numpy()[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = tm[1:] != tm[:-1]
    # each step right costs a fixed amount, so a row is a running minimum after removing it
    right = np.concatenate([[0], np.cumsum(1 + change)])
    row = 2 * np.arange(n + 1)
    for i in range(n):
        apart = np.abs(pt[i] - tt)
        move = row[:-1] + ((apart >= low) & (apart < high)) + (pm[i] != tm)
        best = np.concatenate([[i + 1], np.minimum(move, row[1:] + 1)])
        row = np.minimum.accumulate(best - right) + right
    return int(row[n])


def _fresh(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns under new identities, so that a table can meet one derived from it."""
    return df.select(*[F.col(c).alias(c) for c in columns])


def _coded(left: dict, right: dict) -> tuple[dict, dict]:
    """Points of two blocks with numbers for their labels."""
    a, b = codes(left["mark"], right["mark"])
    sides = [dict(code=c, **{k: np.asarray(v) for k, v in x.items() if k != "mark"}) for c, x in ((a, left), (b, right))]
    return sides[0], sides[1]


def _edit_costs(low: float, high: float) -> Costs:
    """As ``_edit_cost``, for blocks; ``change`` marks points whose label differs from the one before."""

    def move(a: dict, i: int, b: dict) -> np.ndarray:
        apart = np.abs(a["time"][i] - b["time"])
        return ((apart >= low) & (apart < high)).astype(np.int64) + (b["code"] != a["code"][i])

    return Costs(move, 1, lambda right: 1 + np.asarray(right["change"], np.int64))


def _ranked(points: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Points with their place in the series as ``idx``, from 1, and whether their label is a new one."""
    rows = with_blocks(points.select(*keys, "idx", "time", "mark"), keys, "idx", rows_per_block)
    rows = Scan(rows, keys, ["idx"]).row_number("_at").lag("_before", "mark").columns()
    change = F.col("_before").isNull() | (F.col("mark") != F.col("_before"))
    return rows.select(*keys, F.col("_at").alias("idx"), "time", "mark", change.cast("int").alias("change"))


def _sizes(predicted: DataFrame, target: DataFrame, keys: Sequence[str], side: int) -> DataFrame:
    """Points of each series on both sides, and whether one of them is too long for one call."""
    counts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((predicted, "_p"), (target, "_t"))]
    both = counts[0].join(counts[1], list(keys), "full")
    return both.withColumn("_large", F.coalesce(F.greatest("_p", "_t") > side, F.lit(False)))


def label_edits(
    predicted: DataFrame, target: DataFrame, series: Sequence[str], low: float = 1, high: float = 2, side: int = BLOCK_SIDE
) -> DataFrame:
    """Edit count and its share of twice the target length, per series of points.

    Series of up to ``side`` points are compared in one call, longer ones in
    blocks of ``side`` by ``side`` points.
    """
    keys = list(series)

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("idx", ignore_index=True), b.sort_values("idx", ignore_index=True)
        return pd.DataFrame([[*key, _edit_cost(a, b, low, high), 2 * len(b)]])

    types = dict(target.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in keys) + ", edits bigint, total bigint"
    predicted, target = (_fresh(df, [*keys, "idx", "time", "mark"]) for df in (predicted, target))
    sizes = stage(_sizes(predicted, target, keys, side))
    long = sizes.filter("_large")
    if long.isEmpty():
        counted = predicted.groupBy(*keys).cogroup(target.groupBy(*keys)).applyInPandas(compare, shape)
        return counted.withColumn("edit_ratio", edit_ratio("edits", "total"))
    short = [_fresh(df.join(long, keys, "left_anti"), [*keys, "idx", "time", "mark"]) for df in (predicted, target)]
    counted = short[0].groupBy(*keys).cogroup(short[1].groupBy(*keys)).applyInPandas(compare, shape)
    # the longer side is cut to the shorter one
    common = long.select(*keys, F.least(F.coalesce("_p", F.lit(0)), F.coalesce("_t", F.lit(0))).alias("_n"))
    cut = [
        cut_series(_ranked(_fresh(df.join(long, keys, "left_semi"), [*keys, "idx", "time", "mark"]), keys).join(common, keys).filter("idx <= _n").drop("_n"), keys, "idx", ["time", "mark", "change"], side)
        for df in (predicted, target)
    ]
    costs = BlockAlignment(*cut, keys, _edit_costs(low, high), _coded, follow=False).cost("edits")
    blocked = long.join(costs, keys, "left").select(*keys, F.coalesce("edits", F.lit(0)).alias("edits"), (2 * F.coalesce("_t", F.lit(0))).alias("total"))
    return counted.unionByName(blocked).withColumn("edit_ratio", edit_ratio("edits", "total"))


def edit_ratio(edits, total) -> Column:
    return F.when(_c(total) == 0, F.lit(1.0)).otherwise(F.round(_c(edits) / _c(total), 6))


def _lcs_pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Aligned positions of a longest common subsequence; ties step back in ``b`` first."""
    x, y = codes(a, b)
    rows, columns = aligned_path({"code": x}, {"code": y}, COMMON)
    both = (np.diff(rows) == 1) & (np.diff(columns) == 1)
    return list(zip(rows[:-1][both].tolist(), columns[:-1][both].tolist()))


def _matched_distance(left: dict, right: dict, rows: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """Distance and number of the matched points of one block."""
    far = np.abs(np.asarray(left["time"])[rows] - np.asarray(right["time"])[columns])
    return [(float(far.sum()), len(rows))]


def boundary_displacement(predicted: DataFrame, target: DataFrame, series: Sequence[str], side: int = BLOCK_SIDE) -> DataFrame:
    """Distance between matching boundaries per series of points ``idx, time, mark``.

    Series of equal length match by position and are rejected when a label
    differs; the others match along a longest common subsequence.  A target
    series without predictions counts all its points as errors, a predicted
    series without target counts as a series without points.  Returns
    ``distance, points, errors, rejected, span``.

    Series of up to ``side`` points are matched in one call, longer ones in
    blocks of ``side`` by ``side`` points.
    """
    keys = list(series)
    spans = target.groupBy(*keys).agg((F.max_by("time", "idx") - F.min_by("time", "idx")).alias("span"))
    sizes = stage(_sizes(predicted, target, keys, side))
    places = target.select(*keys, "idx", F.col("time").alias("_time"), F.col("mark").alias("_mark"))
    equal = sizes.filter("_p = _t").select(*keys)
    by_place = (
        predicted.select(*keys, "idx", "time", "mark")
        .join(equal, keys, "left_semi")
        .join(places, [*keys, "idx"])
        .groupBy(*keys)
        .agg(
            F.sum(F.abs(F.col("time") - F.col("_time"))).alias("distance"),
            F.count(F.lit(1)).alias("points"),
            F.lit(0).cast("bigint").alias("errors"),
            F.max((F.col("mark") != F.col("_mark")).cast("int")).cast("boolean").alias("rejected"),
        )
    )

    def align(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("idx", ignore_index=True), b.sort_values("idx", ignore_index=True)
        pairs = _lcs_pairs(a["mark"].to_numpy(), b["mark"].to_numpy())
        far = sum(abs(a["time"].iat[i] - b["time"].iat[j]) for i, j in pairs)
        return pd.DataFrame([[*key, float(far), len(pairs), abs(len(pairs) - len(b)), False]])

    types = dict(target.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in keys) + ", distance double, points bigint, errors bigint, rejected boolean"
    columns = [*keys, "idx", "time", "mark"]

    def chosen(condition: str) -> list[DataFrame]:
        other = sizes.filter(condition).select(*keys)
        return [_fresh(df.join(other, keys, "left_semi"), columns) for df in (predicted, target)]

    left, right = chosen("_p != _t AND NOT _large")
    by_label = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(align, shape)
    long = sizes.filter("_p != _t AND _large")
    if not long.isEmpty():
        cut = [cut_series(df, keys, "idx", ["time", "mark"], side) for df in chosen("_p != _t AND _large")]
        parts = BlockAlignment(*cut, keys, COMMON, _coded).along(_matched_distance, "distance double, points bigint")
        sums = parts.groupBy(*keys).agg(F.sum("distance").alias("distance"), F.sum("points").alias("points"))
        matched = F.coalesce("points", F.lit(0))
        by_label = by_label.unionByName(
            long.join(sums, keys, "left").select(
                *keys, F.coalesce("distance", F.lit(0.0)).alias("distance"), matched.alias("points"),
                F.abs(matched - F.col("_t")).alias("errors"), F.lit(False).alias("rejected"),
            )
        )
    nothing = sizes.filter("_p IS NULL OR _t IS NULL").select(
        *keys, F.lit(0.0).alias("distance"), F.lit(0).cast("bigint").alias("points"), F.coalesce("_t", F.lit(0)).alias("errors"), F.lit(False).alias("rejected")
    )
    out = by_place.unionByName(by_label).unionByName(nothing).join(spans, keys, "left")
    return out.withColumn("span", F.coalesce("span", F.lit(0.0)))


def displacement_totals(per_series: DataFrame) -> DataFrame:
    """Distance, ratio to the target span and the error-weighted ratio over all series."""
    fine = ~F.col("rejected")
    t = per_series.agg(
        F.coalesce(F.sum(F.when(fine, F.col("distance"))), F.lit(0.0)).alias("_d"),
        F.coalesce(F.sum(F.when(fine, F.col("points"))), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("_e"),
        F.coalesce(F.sum(F.when(fine, F.col("span"))), F.lit(0.0)).alias("_s"),
        F.count(F.lit(1)).alias("_c"),
        F.count_if("rejected").alias("_r"),
    )
    distance = F.round("_d", 6)
    kept, penalty = 1 - F.col("_e") / F.col("_n"), (F.col("_r") / F.col("_c")) * 0.2
    return t.select(
        distance.alias("distance"),
        F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.round(distance / F.col("_s"), 6)).alias("ratio"),
        F.when((F.col("_s") == 0) | (F.col("_n") == 0) | (F.col("_c") == 0), F.lit(1.0))
        .when(kept + penalty == 0, F.lit(1.0))
        .otherwise(F.round(distance / F.col("_s") / kept + penalty, 6))
        .alias("weighted_ratio"),
    )


def trimmed_mean(
    df: DataFrame, keys: Sequence[str], value: str, threshold: float = 1.5, name: str = "trimmed_mean",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Mean per key without values more than ``threshold`` scaled deviations off the median.

    Values are counted first and medians come from blocked ranks, so a key with
    very many rows is worked by many tasks.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    counts = with_blocks(df.groupBy(*keys, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n")), keys, "_v", rows_per_block)
    limit = block_limit(counts, rows_per_block)
    middle = exact_median(counts, keys, "_v", "_n", "_median", limit)

    def beside(rows: DataFrame, figures: DataFrame) -> DataFrame:
        """Rows with the figures of their key; salted only where some key is large."""
        return rows.join(figures, keys) if limit is None else salted_join(rows, figures, keys, ["_v"])

    off = beside(counts.drop(BLOCK), middle).withColumn("_off", F.abs(F.col("_v") - F.col("_median")))
    off_counts = off.groupBy(*keys, "_off").agg(F.sum("_n").alias("_n"))
    mad = exact_median(off_counts, keys, "_off", "_n", "_mad", limit)
    rows = beside(off, mad)
    kept = (F.col("_mad") != 0) & (F.col("_off") / (F.col("_mad") * 1.4826) <= threshold)
    return rows.groupBy(*keys).agg(
        F.coalesce(
            F.sum(F.when(kept, F.col("_v") * F.col("_n"))) / F.sum(F.when(kept, F.col("_n"))), F.first("_median")
        ).alias(name),
        F.first("_median").alias("median"),
        F.coalesce(F.sum(F.when(kept, F.col("_n"))), F.lit(0)).alias("kept"),
    )


def median_spread(
    df: DataFrame, keys: Sequence[str], value: str, scale: float, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Median, mean distance to it, and how concentrated the values are (1 to 0)."""
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    middle = exact_median(counts, keys, "_v", "_n", "median", rows_per_block)
    rows = salted_join(counts, middle, keys, ["_v"])
    spread = F.sum(F.abs(F.col("_v") - F.col("median")) * F.col("_n")) / F.sum("_n")
    out = rows.groupBy(*keys).agg(F.first("median").alias("median"), spread.alias("spread"))
    return out.withColumn("strength", F.greatest(F.lit(0.0), 1.0 - F.least(F.col("spread") / scale, F.lit(1.0))))


def majority_sequence(df: DataFrame, group: Sequence[str], index: str, sequence: str) -> DataFrame:
    """Most frequent identical sequence per group: ties to the longer, then the first one.

    A group without a repeat has no majority, unless it holds one row only.
    """
    counted = df.groupBy(*group, sequence).agg(F.count(F.lit(1)).alias("_n"), F.min(index).alias("_first"))
    place = F.struct("_n", F.size(sequence).alias("_len"), (-F.col("_first")).alias("_f"))
    best = counted.groupBy(*group).agg(
        F.max_by(F.struct(sequence, "_n"), place).alias("_b"), F.sum("_n").alias("_all")
    )
    return best.filter((F.col("_b._n") > 1) | (F.col("_all") == 1)).select(
        *group, F.col(f"_b.{sequence}").alias(sequence), F.col("_b._n").alias("votes"), F.col("_all").alias("runs")
    )


def agreeing_runs(
    rows: DataFrame, group: Sequence[str], run: str, index: str, label: str, rows_per_block: int | None = ROWS_PER_BLOCK
) -> DataFrame:
    """Runs with the most frequent label sequence of each group: ``(group, run, votes, runs, points)``.

    As ``majority_sequence``, for sequences of any length: a run is known by its
    number of points and two sums of hashes of each label at its place, which are
    added up in any order, and no sequence is gathered.  Winners are held
    against the first of them label by label, so that equal sums alone decide
    nothing.
    """
    keys = list(group)
    placed = with_blocks(rows.select(*keys, run, index, label), [*keys, run], index, rows_per_block)
    placed = Scan(placed, [*keys, run], [index]).row_number("_place").columns().select(*keys, run, "_place", label)
    named = F.coalesce(F.col(label).cast("string"), F.lit("\0"))
    sums = [F.sum(F.xxhash64("_place", named, F.lit(seed)).cast("decimal(20,0)")).alias(f"_sum{seed}") for seed in (1, 2)]
    digests = stage(placed.groupBy(*keys, run).agg(F.count(F.lit(1)).alias("points"), *sums))
    kinds = digests.groupBy(*keys, "points", "_sum1", "_sum2").agg(F.count(F.lit(1)).alias("votes"), F.min(run).alias("_lead"))
    place = F.struct("votes", "points", (-F.col("_lead")).alias("_f"))
    best = kinds.groupBy(*keys).agg(F.max_by(F.struct("points", "_sum1", "_sum2", "votes", "_lead"), place).alias("_b"), F.sum("votes").alias("runs"))
    best = best.select(*keys, "_b.*", "runs").filter("votes > 1 OR runs = 1")
    winners = stage(digests.join(best, [*keys, "points", "_sum1", "_sum2"]).select(*keys, run, "votes", "runs", "points", "_lead"))
    lead = placed.join(winners.filter(F.col(run) == F.col("_lead")).select(*keys, run), [*keys, run], "left_semi")
    lead = lead.select(*keys, "_place", F.col(label).alias("_want"))
    others = placed.join(winners.filter(F.col(run) != F.col("_lead")).select(*keys, run), [*keys, run], "left_semi")
    unlike = others.join(lead, [*keys, "_place"]).filter(~F.col(label).eqNullSafe(F.col("_want"))).select(*keys, run).distinct()
    return winners.join(unlike, [*keys, run], "left_anti").drop("_lead")


def trimmed_mean_of(values: Column, threshold: float = 1.5) -> Column:
    """As ``trimmed_mean``, of the numbers of a short array."""

    def middle(v: Column) -> Column:
        s = F.array_sort(v)
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    def bound(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def mean(median: Column) -> Column:
        def kept(mad: Column) -> Column:
            near = F.filter(values, lambda v: F.abs(v - median) / (mad * 1.4826) <= threshold)
            total = F.aggregate(near, F.lit(0.0), lambda s, v: s + v)
            return F.when((mad == 0) | (F.size(near) == 0), median).otherwise(total / F.size(near))

        return bound(middle(F.transform(values, lambda v: F.abs(v - median))), kept)

    return bound(middle(values), mean)


def group_durations(
    df: DataFrame, labels: str, durations: str, spans: str, unvoiced: Sequence[str] | None = None, condition: str = "all"
) -> DataFrame:
    """Sum child durations per parent and flag parents by their children.

    ``spans`` holds the number of children per parent.  A parent is unvoiced (0)
    when its leading child, or all of them, are in ``unvoiced``.  Adds the array
    ``words`` of ``struct(duration, voiced)``.
    """
    sp = F.col(spans)

    def word(count, i):
        begin = F.aggregate(F.slice(sp, 1, i), F.lit(0), lambda a, v: a + v.cast("int")) + 1
        own = F.slice(labels, begin, count.cast("int"))
        total = F.aggregate(F.slice(durations, begin, count.cast("int")), F.lit(0.0), lambda a, v: a + v)
        if unvoiced is None:
            quiet = F.lit(False)
        elif condition == "lead":
            quiet = F.get(own, F.lit(0)).isin(*unvoiced)
        else:
            quiet = F.forall(own, lambda x: x.isin(*unvoiced))
        return F.struct(total.alias("duration"), F.when(quiet, 0).otherwise(1).alias("voiced"))

    return df.withColumn("words", F.transform(sp, word))


def outcome_counts(df: DataFrame, status: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per status."""
    return df.groupBy(*keys, status).agg(F.count(F.lit(1)).alias("n"))
