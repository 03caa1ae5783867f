"""Smoothing, filling and sampling of numeric series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fold import Fold, Settling
from tidemark.functions.arrays import pad
from tidemark.functions.grid import _c
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, Scan, block_limit, null_safe_left, with_blocks


def moving_upper_median(
    df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, radius: int = 2, name: str = "smoothed",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Upper median over ``radius`` rows to both sides, fewer at the ends."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    # nulls count as the greatest values
    item = F.struct(F.col(value).isNull().alias("none"), F.col(value).alias("v"))
    rows = Scan(rows, series, order).history("_h", item, radius).future("_f", item, radius).columns()
    window = F.concat("_h", F.array(item), "_f")
    middle = F.get(F.sort_array(window), F.floor(F.size(window) / 2).cast("int")).getField("v")
    return rows.select(*df.columns, middle.alias(name))


def despike(
    df: DataFrame, run: Sequence[str], order: Sequence[str], value: str, name: str = "smoothed", limit: float = 75.0,
    blend: float = 0.7, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Pull values more than ``limit`` off their neighbours towards them, left to right.

    The left neighbour counts with its new value, so this is a fold over each
    ``run``, whose last column is an integer number.  The first and the last
    row of a run stay.
    """
    rows = with_blocks(df, run, order[0], rows_per_block)
    rows = rows.withColumn("_value", F.col(value).cast("double"))
    rows = Scan(rows, run, order).lag("_left", "_value").lead("_right", "_value").columns()
    ends = F.col("_left").isNull() | F.col("_right").isNull()
    rows = rows.withColumns({"_end": ends, "_right": F.coalesce("_right", "_value")})
    fold = Fold(_Despike(limit, blend), run, order, ["_value", "_right"], "_end", numbered=True)
    return fold.states(rows, "_state", block_limit(rows, rows_per_block)).select(*df.columns, F.col("_state").cast("bigint").alias(name))


class _Despike(Settling):
    """A value drawn towards the mean of its new left and its old right neighbour where it is far off."""

    def __init__(self, limit: float, blend: float):
        self.limit, self.blend = limit, blend

    def fresh(self, value, right):
        return value

    def next(self, state, value, right):
        off = value - (state + right) / 2.0
        return float(np.rint(value - off * self.blend)) if abs(off) > self.limit else value

    def all_states(self, state, starts, value, right):
        before = np.concatenate([[state], value[:-1]])
        # a row keeps its value where it is near its neighbours and the row before kept its own
        far = np.flatnonzero((np.abs(value - (before + right) / 2.0) > self.limit) & ~starts)
        out, done = value.copy(), 0
        for at in far.tolist():
            if at < done:
                continue
            last, done = (state if at == 0 else float(out[at - 1])), at
            while done < len(out) and not starts[done]:
                own = float(value[done])
                last = out[done] = self.next(last, own, float(right[done]))
                done += 1
                if last == own:
                    break
        return out

    def together(self, states, value, right):
        off = value - (states + right) / 2.0
        return np.where(np.abs(off) > self.limit, np.rint(value - off * self.blend), value)


def fill_short_gaps(
    df: DataFrame, series: Sequence[str], x: str, y: str, step: int = 5, max_steps: int = 12,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Fill gaps of up to ``max_steps`` missing grid points linearly: ``(series, x, y)``; blocks given stay."""
    known = [BLOCK] if BLOCK in df.columns else []
    rows = with_blocks(df.select(*series, x, y, *known), series, x, rows_per_block)
    rows = Scan(rows, series, [x]).lead("_x", x).lead("_y", y).columns()
    missing = F.greatest(F.lit(0), F.floor((F.col("_x") - F.col(x)) / step) - 1).cast("int")
    missing = F.when(missing.between(1, max_steps), missing).otherwise(F.lit(0))
    rows = rows.withColumn("_missing", F.coalesce(missing, F.lit(0)))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_missing"))))
    filled = F.rint(F.col(y) + (F.col("_y") - F.col(y)) * (F.col("_k") / (F.col("_missing") + 1)))
    return rows.select(
        *series,
        (F.col(x) + F.col("_k") * step).alias(x),
        F.when(F.col("_k") == 0, F.col(y)).otherwise(filled.cast("bigint")).alias(y),
        *known,
    )


def interpolate_linear(
    df: DataFrame, series: Sequence[str], index: str, value: str, name: str = "filled", rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Fill NULL and NaN values between valid ones linearly and hold the ends."""
    rows = with_blocks(df, series, index, rows_per_block)
    v = F.when(F.isnan(F.col(value).cast("double")), F.lit(None)).otherwise(F.col(value)).cast("double")
    point = F.when(v.isNotNull(), F.struct(F.col(index).alias("i"), v.alias("v")))
    rows = Scan(rows, series, [index]).last_valid("_a", point).next_valid("_b", point).columns()
    ratio = (F.col(index) - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = (
        F.when(v.isNotNull(), v)
        .when(F.col("_a").isNull(), F.col("_b.v"))
        .when(F.col("_b").isNull(), F.col("_a.v"))
        .otherwise(F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * ratio)
    )
    return rows.select(*df.columns, filled.alias(name))


def edge_features(
    df: DataFrame, series: Sequence[str], index: str, value: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Difference to the next value and clipped sum with the one before."""
    rows = with_blocks(df, series, index, rows_per_block)
    rows = Scan(rows, series, [index]).lag("_b", value).lead("_a", value).columns()
    total = F.col(value) + F.coalesce("_b", F.lit(0.0))
    return rows.select(
        *df.columns,
        F.coalesce(F.col("_a") - F.col(value), F.lit(0.0)).alias("edge_diff"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)).alias("edge_prob"),
    )


def fixed_chunks(df: DataFrame, pos: str, size: int) -> DataFrame:
    """Chunk number and place of each sample for a fixed chunk size."""
    return df.withColumn("chunk", F.floor(F.col(pos) / size)).withColumn("at", F.col(pos) % size)


def padded_chunks(df: DataFrame, series: Sequence[str], pos: str, value: str, size: int, fill: float = 0.0) -> DataFrame:
    """Chunks of exactly ``size`` values per series, the last one padded: ``(series, chunk, values, used)``."""
    rows = fixed_chunks(df, pos, size)
    packed = rows.groupBy(*series, "chunk").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x.getField(value)).alias("values")
    )
    used = F.size("values")
    return packed.select(
        *series, "chunk", F.concat("values", F.array_repeat(F.lit(fill), F.lit(size) - used)).alias("values"), used.alias("used")
    )


def event_rows(
    df: DataFrame, series: Sequence[str], order: Sequence[str], on: str, off: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """On and off events with non-negative distances in ticks.

    Starts are moved to the end before, ends to at least one tick after the
    start.  Adds ``kind``, ``tick`` and ``delta`` to two rows per input row.
    """
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).row_number("_i").columns()
    least_end = F.greatest(F.col(off), F.col(on) + 1)
    rows = Scan(rows, series, order).running_max("_m", least_end - F.col("_i")).columns()
    rows = rows.withColumn("_end", F.col("_i") + F.greatest(F.lit(0), F.col("_m")))
    rows = Scan(rows, series, order).lag("_before", "_end").columns()
    before = F.coalesce("_before", F.lit(0))
    start = F.greatest(F.col(on), before)

    def event(kind: str, tick: Column, delta: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), tick.cast("bigint").alias("tick"), delta.cast("bigint").alias("delta"))

    both = F.array(event("on", start, start - before), event("off", F.col("_end"), F.col("_end") - start))
    return rows.select(*df.columns, F.inline(both))


def mono_progress(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Progress that never goes back and stays below 100: adds ``progress``."""
    rows = with_blocks(df, series, order[0], rows_per_block)
    rows = Scan(rows, series, order).running_max("_p", value).columns()
    return rows.select(*df.columns, F.least(F.lit(99), F.greatest(F.lit(0), F.col("_p"))).cast("int").alias("progress"))


def throughput(df: DataFrame, keys: Sequence[str], audio: str, cost: str, tokens: str, token_time: str) -> DataFrame:
    """Real-time factor and token rate per key, 0 where the divisor is 0."""

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return df.groupBy(*keys).agg(
        ratio(F.sum(cost), F.sum(audio)).alias("rtf"),
        ratio(F.sum(tokens).cast("double"), F.sum(token_time)).alias("tokens_per_sec"),
        F.sum(audio).alias("audio_sec"),
    )


def shared_cost(df: DataFrame, batch: Sequence[str], cost: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Split the cost of a batch evenly over its rows: adds ``share``."""
    rows = with_blocks(df, batch, cost, rows_per_block)
    rows = Scan(rows, batch, [cost]).total("_n", F.lit(1)).columns()
    return rows.select(*df.columns, (F.col(cost) / F.col("_n")).alias("share"))


def geometric_confidence(x) -> Column:
    """Cube root of the geometric mean of probabilities."""
    return F.exp(F.avg(F.log(_c(x) + 1e-6)) / 3)


def pad_to_longest(
    df: DataFrame, group: Sequence[str], arrays: Mapping[str, object], length: str = "length", mask: str = "mask"
) -> DataFrame:
    """Arrays of the rows of each group padded on the right to the longest row of the group.

    ``arrays`` names parallel array columns and what they are padded with.  Adds
    the ``length`` before and a ``mask`` of 1 for real elements; a null array is
    an empty one.  The longest length is one number per group, joined back, so
    arrays are moved once at most.
    """
    first = next(iter(arrays))
    sized = df.withColumn(length, F.coalesce(F.size(first), F.lit(0)))
    sized = sized.withColumn(length, F.greatest(F.col(length), F.lit(0)))
    longest = sized.groupBy(*group).agg(F.max(length).alias("_longest"))
    rows = null_safe_left(sized, longest, group)
    types = dict(df.dtypes)
    none = {c: F.array().cast(types[c]) for c in arrays}
    padded = {c: pad(F.coalesce(F.col(c), none[c]), F.col("_longest"), fill) for c, fill in arrays.items()}
    places = F.when(F.col("_longest") > 0, F.sequence(F.lit(1), F.col("_longest"))).otherwise(F.array().cast("array<int>"))
    return rows.select(
        *[padded[c].cast(types[c]).alias(c) if c in arrays else F.col(c) for c in df.columns], length,
        F.transform(places, lambda i: (i <= F.col(length)).cast("int")).alias(mask),
    )
