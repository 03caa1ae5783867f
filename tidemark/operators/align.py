"""Alignment of long sequences in bounded memory.

A table of n by m costs is cut into square blocks.  A block needs the costs along its upper and left edge and gives
those along its lower and right edge, so all blocks of one diagonal run in parallel and a block never holds more than
its own edges and one row.  With each cost goes the place on the block's edge at which the path to that cell comes in;
paths are then followed from block to block by edges alone, and only the blocks on them are run again, all at once,
for the steps inside.

Where several steps cost the same, the first in a fixed order is taken, as a walk back through the whole table would.
A step that a walk through the whole table takes is also the first inside any part of the table that the path crosses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scan import ROWS_PER_BLOCK, Scan, with_blocks
from tidemark.session import stage

#: Points along one side of a block.
BLOCK_SIDE = 8_192
NEVER = 1 << 28
DIAGONAL, UP, LEFT = 0, 1, 2


@dataclass(frozen=True)
class Costs:
    """Prices of steps: ``across`` (one point of the left side against all of the right), ``up`` and ``left``.

    ``left_first`` tells which of the two goes first where both cost the same; a diagonal step goes before both.
    """

    across: Callable[[dict, int, dict], np.ndarray]
    up: int = 1
    left: Callable[[dict], np.ndarray] = lambda right: np.ones(len(right["code"]), np.int64)
    left_first: bool = False


#: Unit costs; a substitution goes before a deletion and that before an insertion.
EDITS = Costs(lambda a, i, b: (b["code"] != a["code"][i]).astype(np.int64))
#: Longest common subsequence as the least of -1 per match; ties step back on the right side first.
COMMON = Costs(
    lambda a, i, b: np.where(b["code"] == a["code"][i], -1, NEVER), 0, lambda right: np.zeros(len(right["code"]), np.int64), True
)


def _rows(a: dict, b: dict, costs: Costs, top: np.ndarray, side: np.ndarray, follow: bool):
    """Rows of a block below its upper edge: (place, costs, steps taken); steps only if ``follow``."""
    run = np.concatenate([[0], np.cumsum(costs.left(b))])
    row = top
    for i in range(len(a["code"])):
        diagonal, above = row[:-1] + costs.across(a, i, b), row[1:] + costs.up
        best = np.concatenate([side[i + 1 : i + 2], np.minimum(diagonal, above)])
        new = np.minimum.accumulate(best - run) + run
        steps = None
        if follow:
            inner = new[1:]
            from_left, from_above = inner == new[:-1] + (run[1:] - run[:-1]), inner == above
            later = np.where(from_left, LEFT, UP) if costs.left_first else np.where(from_above, UP, LEFT)
            steps = np.where(inner == diagonal, DIAGONAL, later).astype(np.uint8)
        row = new
        yield i, row, steps


def block_edges(a: dict, b: dict, costs: Costs, top: np.ndarray, side: np.ndarray, follow: bool = True):
    """Costs along the lower and right edge of a block, and where the paths to these cells come in.

    Entries are places on the upper edge (0 to m), then on the left edge (m + 1 to m + n).
    """
    n, m = len(a["code"]), len(b["code"])
    places = np.arange(m + 1)
    entry, row = places, top
    right, right_entry = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
    right[0], right_entry[0] = top[m], m
    for i, row, steps in _rows(a, b, costs, top, side, follow):
        if follow:
            came = np.empty(m + 1, np.int64)
            came[0] = m + 1 + i
            came[1:] = np.where(steps == DIAGONAL, entry[:-1], entry[1:])
            # a step to the left has the entry of the last cell before it that has another
            own = places.copy()
            own[1:][steps == LEFT] = 0
            entry = came[np.maximum.accumulate(own)]
            right_entry[i + 1] = entry[m]
        right[i + 1] = row[m]
    return row, right, entry, right_entry


def block_path(a: dict, b: dict, costs: Costs, top: np.ndarray, side: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the path from cell (i, j) back to the block's upper or left edge: places before and after, as cells."""
    part = {k: v[:i] for k, v in a.items()}, {k: v[:j] for k, v in b.items()}
    taken = np.zeros((i, j), np.uint8)
    for k, _, steps in _rows(*part, costs, top[: j + 1], side[: i + 1], True):
        taken[k] = steps
    rows, columns = [i], [j]
    while i and j:
        step = taken[i - 1, j - 1]
        i, j = i - (step != LEFT), j - (step != UP)
        rows.append(i)
        columns.append(j)
    return np.asarray(rows[::-1]), np.asarray(columns[::-1])


def edges_of(a: dict, b: dict, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Upper and left edge of a whole table."""
    return np.concatenate([[0], np.cumsum(costs.left(b))]), np.arange(len(a["code"]) + 1) * costs.up


def path(a: dict, b: dict, costs: Costs, most: int = BLOCK_SIDE * BLOCK_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the whole path of two sequences, from (0, 0) to (n, m).

    Tables above ``most`` cells are halved where the path crosses their middle row, so memory grows with the lengths.
    """
    n, m = len(a["code"]), len(b["code"])
    top, side = edges_of(a, b, costs)
    if n * m > most and n > 1:
        half = n // 2
        first = {k: v[:half] for k, v in a.items()}
        middle = block_edges(first, b, costs, top, side[: half + 1], False)[0]
        second = {k: v[half:] for k, v in a.items()}
        lower = block_edges(second, b, costs, middle, side[half:])
        at = int(lower[2][m])
        if at <= m:
            upper = path(first, {k: v[:at] for k, v in b.items()}, costs, most)
            below = path(second, {k: v[at:] for k, v in b.items()}, costs, most)
            return np.concatenate([upper[0], below[0][1:] + half]), np.concatenate([upper[1], below[1][1:] + at])
        # the path comes down the left edge past the middle
        i = half + at - m
        below = path({k: v[i:] for k, v in a.items()}, b, costs, most)
        return np.concatenate([np.arange(i), below[0] + i]), np.concatenate([np.zeros(i, np.int64), below[1]])
    rows, columns = block_path(a, b, costs, top, side, n, m)
    lead = np.arange(max(rows[0], columns[0]))
    return np.concatenate([lead if rows[0] else np.zeros(len(lead), np.int64), rows]), np.concatenate([lead if columns[0] else np.zeros(len(lead), np.int64), columns])


def short_steps(left: list[np.ndarray], right: list[np.ndarray], cells: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Steps of the whole paths of many short pairs of codes under ``EDITS``: number, left and right places, -1 for a gap.

    Pairs of about one size are worked together, a row of all their tables at a time.
    """
    n, m = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        few = order[at : at + max(1, cells // int((n[order[at]] + 1) * (m.max() + 1)))]
        at += len(few)
        high, wide, count = int(n[few].max()), int(m[few].max()), len(few)
        a, b = np.full((high, count), -1, np.int64), np.full((count, wide), -1, np.int64)
        for k, p in enumerate(few):
            a[: n[p], k], b[k, : m[p]] = left[p], right[p]
        run = np.arange(wide + 1)
        row = np.broadcast_to(run, (count, wide + 1))
        taken = np.empty((high, count, wide), np.uint8)
        for i in range(high):
            diagonal, above = row[:, :-1] + (b != a[i][:, None]), row[:, 1:] + 1
            best = np.concatenate([np.full((count, 1), i + 1), np.minimum(diagonal, above)], axis=1)
            row = np.minimum.accumulate(best - run, axis=1) + run
            inner = row[:, 1:]
            taken[i] = np.where(inner == diagonal, DIAGONAL, np.where(inner == above, UP, LEFT))
        i, j, each = n[few], m[few], np.arange(count)
        steps = []
        while True:
            open_ = (i > 0) | (j > 0)
            if not open_.any():
                break
            step = np.where(j == 0, UP, LEFT)
            inside = np.flatnonzero((i > 0) & (j > 0))
            step[inside] = taken[i[inside] - 1, each[inside], j[inside] - 1]
            down, across = open_ & (step != LEFT), open_ & (step != UP)
            i, j = i - down, j - across
            steps.append((open_, np.where(down, i, -1), np.where(across, j, -1)))
        # a path's steps come last first, and those of a shorter one end sooner
        lengths = sum((s[0] for s in steps), np.zeros(count, np.int64))
        x, y = (np.array([s[side] for s in reversed(steps)]).reshape(len(steps), count).T for side in (1, 2))
        for k, p in enumerate(few):
            begin = len(steps) - int(lengths[k])
            yield int(p), x[k, begin:], y[k, begin:]


def codes(*lists: Sequence) -> list[np.ndarray]:
    """Numbers that are equal where the values are."""
    flat = pd.factorize(np.concatenate([np.asarray(x, dtype=object) for x in lists]), use_na_sentinel=False)[0] if any(map(len, lists)) else np.zeros(0, np.int64)
    return np.split(flat, np.cumsum([len(x) for x in lists])[:-1])


def cut_series(df: DataFrame, series: Sequence[str], order: str, values: Sequence[str], side: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Series in blocks of ``side`` points: ``(series, block, values...)``, each value an array in order."""
    rows = Scan(with_blocks(df.select(*series, order, *values), series, order, rows_per_block), series, [order]).row_number("_at").columns()
    point = F.struct("_at", *values)
    cut = rows.groupBy(*series, F.floor((F.col("_at") - 1) / side).alias("block")).agg(F.array_sort(F.collect_list(point)).alias("_points"))
    return cut.select(*series, "block", *[F.col(f"_points.{v}").alias(v) for v in values])


EDGE = "_bottom array<bigint>, _right array<bigint>, _bottom_entry array<bigint>, _right_entry array<bigint>"


class BlockAlignment:
    """Alignment of pairs of series in blocks; ``prepare(left, right)`` turns two blocks into what ``costs`` reads.

    ``left`` and ``right`` come from ``cut_series``.  Every diagonal is one job whose edges are written once, so a
    lost executor costs no more than a diagonal, and the number of jobs grows with the longest series.
    """

    def __init__(self, left: DataFrame, right: DataFrame, series: Sequence[str], costs: Costs, prepare: Callable[[dict, dict], tuple[dict, dict]], follow: bool = True):
        self.series, self.costs, self.prepare, self.follow = list(series), costs, prepare, follow
        self.values = [c for c in left.columns if c not in [*series, "block"]]
        self.left = left.select(*series, F.col("block").alias("_i"), *[F.col(c).alias(f"_a_{c}") for c in self.values])
        self.right = right.select(*series, F.col("block").alias("_j"), *[F.col(c).alias(f"_b_{c}") for c in self.values])
        sizes = [df.groupBy(*series).agg((F.max(at) + 1).alias(n)) for df, at, n in ((self.left, "_i", "_rows"), (self.right, "_j", "_columns"))]
        self.sizes = stage(sizes[0].join(sizes[1], self.series))
        self.kinds = ", ".join(f"`{c}` {t}" for c, t in left.dtypes if c in series)
        self.edges = self._run()

    def _cells(self, d: int) -> DataFrame:
        """Blocks of one diagonal with both sides' values."""
        low = F.greatest(F.lit(0), F.lit(d) - F.col("_columns") + 1)
        high = F.least(F.lit(d), F.col("_rows") - 1)
        here = self.sizes.filter(low <= high).select(*self.series, "_rows", "_columns", F.explode(F.sequence(low, high)).alias("_i"))
        here = here.withColumn("_j", F.lit(d).cast("bigint") - F.col("_i"))
        return here.join(self.left, [*self.series, "_i"]).join(self.right, [*self.series, "_j"])

    def _edged(self, cells: DataFrame, before: DataFrame | None) -> DataFrame:
        """Cells with the lower edge of the block above and the right edge of the block before."""
        if before is None:
            none = F.lit(None).cast("array<bigint>")
            return cells.withColumns({"_top": none, "_side": none})
        above = before.select(*self.series, (F.col("_i") + 1).alias("_i"), "_j", F.col("_bottom").alias("_top"))
        ahead = before.select(*self.series, "_i", (F.col("_j") + 1).alias("_j"), F.col("_right").alias("_side"))
        keys = [*self.series, "_i", "_j"]
        return cells.join(above, keys, "left").join(ahead, keys, "left")

    def _spread(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        """About one block for each task, as a block is much larger than a row."""
        most = self.sizes.agg(F.sum(F.least("_rows", "_columns"))).first()[0] or 1
        return cells.repartition(int(min(most, 10_000)), *keys)

    def _inputs(self):
        """Reads the values and edges of one row of ``_edged``."""
        values, prepare, costs = self.values, self.prepare, self.costs

        def read(row: dict):
            a, b = prepare({c: row[f"_a_{c}"] for c in values}, {c: row[f"_b_{c}"] for c in values})
            top = None if row["_top"] is None else np.asarray(row["_top"], np.int64)
            side = None if row["_side"] is None else np.asarray(row["_side"], np.int64)
            upper, left = edges_of(a, b, costs)
            # along the table's own edges every step goes one way
            if top is None:
                top = upper + (side[0] if side is not None else 0)
            if side is None:
                side = left + top[0]
            return a, b, top, side

        return read

    def _run(self) -> DataFrame:
        keys, costs, follow, read = [*self.series, "_i", "_j"], self.costs, self.follow, self._inputs()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    a, b, top, side = read(row)
                    bottom, right, entry, right_entry = block_edges(a, b, costs, top, side, follow)
                    made = [*[row[c] for c in keys], bottom, right, entry if follow else [], right_entry if follow else []]
                    yield pd.DataFrame([made], columns=[*keys, "_bottom", "_right", "_bottom_entry", "_right_entry"])

        shape = f"{self.kinds}, _i bigint, _j bigint, {EDGE}"
        rounds = self.sizes.agg(F.max(F.col("_rows") + F.col("_columns") - 1)).first()[0] or 0
        done: list[DataFrame] = []
        for d in range(rounds):
            cells = self._edged(self._cells(d), done[-1] if done else None)
            done.append(stage(self._spread(cells, keys).mapInPandas(run, shape)))
        if not done:
            return self.sizes.sparkSession.createDataFrame([], shape)
        return reduce(DataFrame.union, done)

    def cost(self, name: str = "cost") -> DataFrame:
        """Cost of each pair."""
        last = (F.col("_i") == F.col("_rows") - 1) & (F.col("_j") == F.col("_columns") - 1)
        return self.edges.join(self.sizes, self.series).filter(last).select(*self.series, F.element_at("_bottom", -1).alias(name))

    def _crossed(self) -> DataFrame:
        """Blocks on the path of each pair and the cell at which the path leaves them."""
        series = self.series

        def walk(key, blocks: pd.DataFrame) -> pd.DataFrame:
            at = {(i, j): (b, r) for i, j, b, r in zip(blocks["_i"], blocks["_j"], blocks["_bottom_entry"], blocks["_right_entry"])}
            i, j = max(at)
            row, column, found = len(at[i, j][1]) - 1, len(at[i, j][0]) - 1, []
            while True:
                bottom, right = at[i, j]
                found.append((*key, i, j, row, column))
                entry = int(bottom[column] if row == len(right) - 1 else right[row])
                width = len(bottom) - 1
                up, left = entry <= width, entry == 0 or entry > width
                if (up and i == 0) or (left and j == 0):
                    break
                i, j = i - up, j - left
                row = len(at[i, j][1]) - 1 if up else entry - width
                column = len(at[i, j][0]) - 1 if left else entry
            return pd.DataFrame(found, columns=[*series, "_i", "_j", "_row", "_column"])

        shape = f"{self.kinds}, _i bigint, _j bigint, _row bigint, _column bigint"
        return self.edges.drop("_bottom", "_right").groupBy(*series).applyInPandas(walk, shape)

    def along(self, fold: Callable[[dict, dict, np.ndarray, np.ndarray], list[tuple]], shape: str) -> DataFrame:
        """``fold`` over the diagonal steps of every block on a path: values of both sides and places in their blocks.

        Returns ``(series, _i, _j)`` and the columns of ``shape``, a row per tuple of ``fold``.
        """
        keys, costs, read, values = [*self.series, "_i", "_j"], self.costs, self._inputs(), self.values
        names = [part.split()[0] for part in shape.split(",")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.to_dict("records"):
                    a, b, top, side = read(row)
                    rows, columns = block_path(a, b, costs, top, side, row["_row"], row["_column"])
                    both = (np.diff(rows) == 1) & (np.diff(columns) == 1)
                    made = fold({c: row[f"_a_{c}"] for c in values}, {c: row[f"_b_{c}"] for c in values}, rows[:-1][both], columns[:-1][both])
                    yield pd.DataFrame([(*[row[c] for c in keys], *x) for x in made], columns=[*keys, *names])

        on_path = stage(self._crossed())
        cells = on_path.join(self.left, [*self.series, "_i"]).join(self.right, [*self.series, "_j"])
        return self._spread(self._edged(cells, self.edges), keys).mapInPandas(run, f"{self.kinds}, _i bigint, _j bigint, {shape}")
