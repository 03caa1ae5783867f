"""Ordered scans over series of any size.

A running value over a series is usually one window partitioned by the series
key.  That puts a whole series in one task, so a series that holds a third of
all rows decides the run time.  The scans here treat such series apart:

1. ``with_blocks`` counts the rows per series in one small job.  Where no series
   is above ``rows_per_block`` it returns its input and every scan is a plain
   window.  Otherwise the large series are cut into equal time blocks; all other
   series keep a NULL block.
2. ``Scan`` then runs each window inside ``(series, block)``, reduces every block
   of a large series to one summary row, scans the summaries in block order and
   adds the carried value to the rows of the block.  The block results are
   written to the checkpoint folder once, so chained scans do not repeat work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

BLOCK = "_block"
ROWS_PER_BLOCK = 500_000
#: Rows to one side that are taken one by one.
FEW_ROWS = 4


def with_blocks(
    df: DataFrame,
    series: Sequence[str],
    time: str,
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``_block`` where some series is large: its time block, NULL for the others.

    Runs one job that counts rows per series; only the few large series, at most
    one per ``rows_per_block`` rows, are kept from it.  ``None`` skips the job
    where the caller knows that no series is large.
    """
    if BLOCK in df.columns or rows_per_block is None:
        return df
    columns = df.columns
    large = (
        df.groupBy(*series)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_lo"), F.max(time).alias("_hi"))
        .filter(F.col("_n") > rows_per_block)
        .select(
            *series,
            "_lo",
            ((F.col("_hi") - F.col("_lo")) / F.ceil(F.col("_n") / F.lit(rows_per_block / 2))).alias("_width"),
            F.lit(True).alias("_large"),
        )
    )
    large = stage(large)
    if large.isEmpty():
        return df
    # rows without a time come first in any order, so they go to the lowest block
    position = F.when(F.col("_width") > 0, F.coalesce(F.floor((F.col(time) - F.col("_lo")) / F.col("_width")), F.lit(0))).otherwise(0)
    return null_safe_left(df, large, series).select(
        *columns, F.when(F.col("_large"), position.cast("bigint")).alias(BLOCK)
    )


def null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which NULL is a value like any other; the right keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, "left").drop(*[f"_j{i}" for i in range(len(keys))])


def block_limit(checked: DataFrame, rows_per_block: int | None) -> int | None:
    """Limit for tables with no more rows per series than one already checked."""
    return rows_per_block if BLOCK in checked.columns else None


@dataclass(frozen=True)
class _Step:
    name: str
    kind: str
    value: Column
    size: int = 1


class Scan:
    """Collects running values over one order and adds them in one pass.

    ``order`` must be a total order within the series; its first column is the
    time given to ``with_blocks``.
    """

    def __init__(self, df: DataFrame, series: Sequence[str], order: Sequence[str]):
        self._df = df
        self._series = list(series)
        self._order = list(order)
        self._steps: list[_Step] = []

    def _add(self, name: str, kind: str, value: Column | str) -> Scan:
        self._steps.append(_Step(name, kind, F.col(value) if isinstance(value, str) else value))
        return self

    def running_sum(self, name: str, value: Column | str) -> Scan:
        return self._add(name, "running_sum", value)

    def running_max(self, name: str, value: Column | str) -> Scan:
        return self._add(name, "running_max", value)

    def row_number(self, name: str) -> Scan:
        return self._add(name, "running_sum", F.lit(1).cast("bigint"))

    def lag(self, name: str, value: Column | str) -> Scan:
        return self._add(name, "lag", value)

    def lead(self, name: str, value: Column | str) -> Scan:
        return self._add(name, "lead", value)

    def last_valid(self, name: str, value: Column | str) -> Scan:
        """Latest non-NULL value up to and including the row."""
        return self._add(name, "last_valid", value)

    def next_valid(self, name: str, value: Column | str) -> Scan:
        """First non-NULL value from the row on."""
        return self._add(name, "next_valid", value)

    def max_before(self, name: str, value: Column | str) -> Scan:
        """Running maximum over the rows strictly before the row."""
        return self._add(name, "max_before", value)

    def history(self, name: str, value: Column | str, size: int) -> Scan:
        """Array of the values of up to ``size`` rows before the row, oldest first."""
        v = F.col(value) if isinstance(value, str) else value
        self._steps.append(_Step(name, "history", v, size))
        return self

    def future(self, name: str, value: Column | str, size: int) -> Scan:
        """Array of the values of up to ``size`` rows after the row, nearest first."""
        v = F.col(value) if isinstance(value, str) else value
        self._steps.append(_Step(name, "future", v, size))
        return self

    def total(self, name: str, value: Column | str) -> Scan:
        """Sum over the whole series."""
        return self._add(name, "total", value)

    def maximum(self, name: str, value: Column | str) -> Scan:
        return self._add(name, "maximum", value)

    def columns(self) -> DataFrame:
        """The input with every collected value added."""
        blocked = BLOCK in self._df.columns
        kept = self._df.columns
        keys = self._series + ([BLOCK] if blocked else [])
        ahead = Window.partitionBy(*keys).orderBy(*self._order)
        back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in self._order])
        whole = Window.partitionBy(*keys)
        # one column a step, so that sorted rows hold its value once
        rows = self._df.select("*", *[F.struct(s.value.alias("v")).alias(f"_v{i}") for i, s in enumerate(self._steps) if s.kind in ("history", "future")])
        local = rows.select("*", *[self._local(s, ahead, back, whole, F.col(f"_v{i}")).alias(f"_l{i}") for i, s in enumerate(self._steps)])
        local = local.select(*kept, *[self._present(s, F.col(f"_l{i}")).alias(f"_l{i}") for i, s in enumerate(self._steps)])
        if not blocked:
            return local.select(
                *kept,
                *[self._finish(s, F.col(f"_l{i}"), None).alias(s.name) for i, s in enumerate(self._steps)],
            )

        local = stage(local)
        place = F.struct(*[F.col(c) for c in self._order])
        large = local.filter(F.col(BLOCK).isNotNull())
        if any(s.kind in ("history", "future") for s in self._steps):
            large = large.withColumn("_from_start", F.row_number().over(ahead)).withColumn(
                "_from_end", F.row_number().over(back)
            )
        summary = (
            large.groupBy(*keys)
            .agg(*[self._summary(s, place).alias(f"_s{i}") for i, s in enumerate(self._steps)])
        )
        over = Window.partitionBy(*self._series)
        carry = summary.select(
            *keys, *[self._carry(s, F.col(f"_s{i}"), over).alias(f"_c{i}") for i, s in enumerate(self._steps)]
        )
        return null_safe_left(local, carry, keys).select(
            *kept,
            *[
                self._finish(s, F.col(f"_l{i}"), F.col(f"_c{i}")).alias(s.name)
                for i, s in enumerate(self._steps)
            ],
        )

    @staticmethod
    def _local(step: _Step, ahead, back, whole, held: Column) -> Column:
        so_far = ahead.rowsBetween(Window.unboundedPreceding, 0)
        v = step.value
        return {
            "running_sum": lambda: F.sum(v).over(so_far),
            "running_max": lambda: F.max(v).over(so_far),
            "max_before": lambda: F.max(v).over(ahead.rowsBetween(Window.unboundedPreceding, -1)),
            "lag": lambda: F.lag(F.struct(v.alias("v"))).over(ahead),
            "lead": lambda: F.lead(F.struct(v.alias("v"))).over(ahead),
            "history": lambda: Scan._near(held, step.size, F.lag, range(step.size, 0, -1), ahead, (-step.size, -1)),
            "future": lambda: Scan._near(held, step.size, F.lead, range(1, step.size + 1), ahead, (1, step.size)),
            "last_valid": lambda: F.last(v, ignorenulls=True).over(so_far),
            "next_valid": lambda: F.last(v, ignorenulls=True).over(
                back.rowsBetween(Window.unboundedPreceding, 0)
            ),
            "total": lambda: F.sum(v).over(whole),
            "maximum": lambda: F.max(v).over(whole),
        }[step.kind]()

    @staticmethod
    def _near(v: Column, size: int, shift, steps: range, over, frame: tuple[int, int]) -> Column:
        """The values of the rows around; of a few rows one by one, as a sliding list is gathered anew for every row."""
        if size > FEW_ROWS:
            return F.collect_list(v).over(over.rowsBetween(*frame))
        return F.array(*[shift(v, k).over(over) for k in steps])

    @staticmethod
    def _present(step: _Step, found: Column) -> Column:
        """Of the values taken one by one those of rows that there are; missing ones are the first or the last."""
        if step.kind not in ("history", "future") or step.size > FEW_ROWS:
            return found
        n = reduce(add, [F.get(found, k).isNotNull().cast("int") for k in range(step.size)])
        return F.slice(found, F.lit(step.size + 1) - n if step.kind == "history" else F.lit(1), n)

    @staticmethod
    def _summary(step: _Step, place: Column) -> Column:
        v = step.value
        return {
            "running_sum": lambda: F.sum(v),
            "running_max": lambda: F.max(v),
            "max_before": lambda: F.max(v),
            "lag": lambda: F.max_by(F.struct(v.alias("v")), place),
            "lead": lambda: F.min_by(F.struct(v.alias("v")), place),
            "history": lambda: _edge(v, step.size),
            "future": lambda: _edge(v, step.size, first=True),
            "last_valid": lambda: F.max_by(v, F.when(v.isNotNull(), place)),
            "next_valid": lambda: F.min_by(v, F.when(v.isNotNull(), place)),
            "total": lambda: F.sum(v),
            "maximum": lambda: F.max(v),
        }[step.kind]()

    @staticmethod
    def _carry(step: _Step, s: Column, over) -> Column:
        ahead = over.orderBy(BLOCK)
        before = ahead.rowsBetween(Window.unboundedPreceding, -1)
        after = over.orderBy(F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return {
            "running_sum": lambda: F.sum(s).over(before),
            "running_max": lambda: F.max(s).over(before),
            "max_before": lambda: F.max(s).over(before),
            "lag": lambda: F.lag(s).over(ahead),
            "lead": lambda: F.lead(s).over(ahead),
            "history": lambda: F.flatten(F.collect_list(s).over(ahead.rowsBetween(-step.size, -1))),
            "future": lambda: F.flatten(F.collect_list(s).over(ahead.rowsBetween(1, step.size))),
            "last_valid": lambda: F.last(s, ignorenulls=True).over(before),
            "next_valid": lambda: F.last(s, ignorenulls=True).over(after),
            "total": lambda: F.sum(s).over(over),
            "maximum": lambda: F.max(s).over(over),
        }[step.kind]()

    @staticmethod
    def _finish(step: _Step, local: Column, carry: Column | None) -> Column:
        if step.kind in ("lag", "lead"):
            return (local if carry is None else F.coalesce(local, carry)).getField("v")
        if step.kind in ("history", "future"):
            both = local
            if carry is not None:
                beyond = F.coalesce(carry, F.slice(local, 1, 0))
                both = F.concat(beyond, local) if step.kind == "history" else F.concat(local, beyond)
                n = F.least(F.size(both), F.lit(step.size))
                both = F.slice(both, F.size(both) - n + 1, n) if step.kind == "history" else F.slice(both, 1, n)
            return both.getField("v")
        if carry is None:
            return local
        if step.kind == "running_sum":
            return F.when(carry.isNull(), local).otherwise(F.coalesce(local, F.lit(0)) + carry)
        if step.kind in ("running_max", "max_before"):
            return F.greatest(local, carry)
        if step.kind in ("total", "maximum"):
            return F.coalesce(carry, local)
        return F.coalesce(local, carry)


def _edge(value: Column, size: int, first: bool = False) -> Column:
    """The values of the first or last ``size`` rows of a block, in order."""
    near = F.col("_from_start") if first else F.col("_from_end")
    kept = F.collect_list(F.when(near <= size, F.struct(F.col("_from_start").alias("i"), value.alias("v"))))
    return F.transform(F.array_sort(kept), lambda x: F.struct(x.getField("v").alias("v")))


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = 16) -> DataFrame:
    """Equi join of a side with hot keys to a side with one row per key.

    The rows of a hot key are spread over ``salts`` tasks by a hash of
    ``spread``; the small side is repeated once per salt.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(repeated, [*keys, "_salt"]).drop("_salt")


def exact_median(
    counts: DataFrame, keys: Sequence[str], value: str, weight: str, name: str, rows_per_block: int | None = ROWS_PER_BLOCK
) -> DataFrame:
    """Median per key from ``(keys, value, weight)`` rows with distinct values.

    The position of a value comes from a blocked running count, so no key
    gathers its values in one task.
    """
    known = [BLOCK] if BLOCK in counts.columns else []
    rows = with_blocks(counts.select(*keys, *known, value, weight), keys, value, rows_per_block)
    ranked = Scan(rows, keys, [value]).running_sum("_upto", weight).total("_all", weight).columns()
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor(F.col("_all") / 2) + 1
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_upto") >= low, F.col(value)))
                + F.min(F.when(F.col("_upto") >= high, F.col(value)))
            )
            / 2
        ).alias(name)
    )
