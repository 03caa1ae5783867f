"""Left folds over series of any size.

A fold gives every row a state that hangs on the row and on the state before it.  A series up to ``rows_per_block``
rows is folded in one call.  A larger one is cut into blocks: each block sums up, without knowing its entry, what state
it leaves for any state it is entered with; a walk over these summaries finds the entry of every block; and the blocks
then fold their rows in parallel.

Two kinds of folds have small summaries:

* ``Ride``: a state rides along, with a fixed gain per row, until a row breaks it, and what it is then hangs on that row
  alone.  The rows that can be the first to break some entry are the records of the limits, and each leaves one state.
* ``Settling``: the state after a row never falls as the state before rises, and entries run together after some rows.
  The summary is a step function, found by bisection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.chain import call_bucket, map_series
from tidemark.scan import BLOCK, ROWS_PER_BLOCK, null_safe_left, with_blocks
from tidemark.session import stage

#: Rows whose limit is this close to a record count as records too, so that rounding hides none.
CLOSE = 1e-7


class Ride:
    """A state that gains ``step`` per row until a row breaks it."""

    step: float = 0

    def fresh(self, *row) -> float:
        """State of a row that does not hang on the state before."""
        raise NotImplementedError

    def next(self, state: float, *row) -> float:
        """State after a row."""
        raise NotImplementedError

    def limits(self, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows break a state below the first or from the second number on, but for rounding."""
        raise NotImplementedError

    def sides(self, states: np.ndarray, *columns: np.ndarray) -> np.ndarray:
        """-1 or 1 where the row breaks the state from below or above, 0 where it rides on."""
        raise NotImplementedError

    def broken(self, side: int, *row) -> float:
        """State after a row that broke the one before."""
        raise NotImplementedError

    def riding(self, state: float, rows: int) -> np.ndarray:
        """The state before each of ``rows`` rows and after the last, as repeated sums give it."""
        return np.add.accumulate(np.concatenate([[state], np.full(rows, self.step)]))

    def summary(self, fresh: np.ndarray, columns: list[np.ndarray], bounds: tuple[float, float]) -> dict:
        """What a block leaves: ``fixed`` where it does not hang on the entry, else what the records leave."""
        n = len(fresh)
        rows = list(zip(*[c.tolist() for c in columns]))
        starts = np.flatnonzero(fresh)
        if len(starts):
            state, first = None, int(starts[-1])
            for i in range(first, n):
                state = self.fresh(*rows[i]) if i == first else self.next(state, *rows[i])
            return {"fixed": state, "rows": n, "at": [], "below": [], "above": [], "seen": [[] for _ in columns]}
        gained = np.arange(n) * self.step
        low, high = (limit - gained for limit in self.limits(*columns))
        top, least = np.maximum.accumulate(low), np.minimum.accumulate(high)
        near = CLOSE * (1 + np.abs(low)), CLOSE * (1 + np.abs(high))
        records = np.ones(n, bool)
        records[1:] = (low[1:] >= top[:-1] - near[0][1:]) | (high[1:] <= least[:-1] + near[1][1:])
        at = np.flatnonzero(records)
        left: dict[int, dict[int, float]] = {-1: {}, 1: {}}
        known: list[float | None] = [None] * n
        for i in at[::-1].tolist():
            for side in (-1, 1):
                state, j, passed = self.broken(side, *rows[i]), i + 1, []
                passed.append(state)
                # from a row on where both are alike, one goes the way of the other
                while j < n and known[j - 1] != state:
                    state = self.next(state, *rows[j])
                    passed.append(state)
                    j += 1
                if j < n:
                    state = known[n - 1]
                else:
                    known[i:n] = passed
                left[side][i] = state
        return {
            "fixed": None, "rows": n, "at": at.tolist(), "below": [left[-1][i] for i in at.tolist()],
            "above": [left[1][i] for i in at.tolist()], "seen": [c[at].astype(float).tolist() for c in columns],
        }

    def leave(self, state: float, block: dict) -> float:
        """State after a block entered with ``state``."""
        if block["fixed"] is not None and not np.isnan(block["fixed"]):
            return block["fixed"]
        states = self.riding(state, int(block["rows"]))
        at = np.asarray(block["at"], np.int64)
        sides = self.sides(states[at], *[np.asarray(c) for c in block["seen"]])
        hit = np.flatnonzero(sides)
        if not len(hit):
            return float(states[-1])
        return (block["below"] if sides[hit[0]] < 0 else block["above"])[hit[0]]


class Settling:
    """A state that never falls as the one before rises; entries run together.

    States stay within one of the least and the greatest value of all columns of a series.  A kind may have
    ``all_states(state, starts, *columns)``, the states after all rows of an array entered with ``state``; its columns are
    doubles and its flag is never null.
    """

    def fresh(self, *row) -> float:
        raise NotImplementedError

    def next(self, state: float, *row) -> float:
        raise NotImplementedError

    def together(self, states: np.ndarray, *row) -> np.ndarray:
        """``next`` for several states at once."""
        raise NotImplementedError

    def _all(self, states: np.ndarray, rows: list[tuple]) -> np.ndarray:
        """Where each of the entries ends."""
        at, states = 0, states.copy()
        while at < len(rows) and np.ptp(states) > 0:
            states = self.together(states, *rows[at])
            at += 1
        state = float(states[0])
        if at < len(rows):
            for row in rows[at:]:
                state = self.next(state, *row)
            return np.full(len(states), state)
        return states

    def summary(self, fresh: np.ndarray, columns: list[np.ndarray], bounds: tuple[float, float]) -> dict:
        rows = list(zip(*[c.tolist() for c in columns]))
        starts = np.flatnonzero(fresh)
        if len(starts):
            first = int(starts[-1])
            state = self.fresh(*rows[first])
            for row in rows[first + 1 :]:
                state = self.next(state, *row)
            return {"fixed": state, "rows": len(rows), "at": [], "below": [], "above": [], "seen": []}
        # a step starts at its entry; halve every interval whose ends differ until its ends are neighbours
        ends = np.asarray([bounds[0] - 1, bounds[1] + 1])
        values = dict(zip(ends.tolist(), self._all(ends, rows).tolist()))
        open_ = [tuple(ends.tolist())] if len(set(values.values())) > 1 else []
        steps = []
        while open_:
            middles = [_between(a, b) for a, b in open_]
            steps += [b for (a, b), x in zip(open_, middles) if x is None]
            todo = [(a, x, b) for (a, b), x in zip(open_, middles) if x is not None]
            if todo:
                values |= dict(zip([x for _, x, _ in todo], self._all(np.asarray([x for _, x, _ in todo]), rows).tolist()))
            open_ = [p for a, x, b in todo for p in ((a, x), (x, b)) if values[p[0]] != values[p[1]]]
        steps = [float(ends[0]), *sorted(steps)]
        return {"fixed": None, "rows": len(rows), "at": [], "below": steps, "above": [values[s] for s in steps], "seen": []}

    def leave(self, state: float, block: dict) -> float:
        if block["fixed"] is not None and not np.isnan(block["fixed"]):
            return block["fixed"]
        return float(block["above"][int(np.searchsorted(block["below"], state, "right")) - 1])


def _between(a: float, b: float) -> float | None:
    """The middle of two numbers; None where they are neighbours."""
    if np.nextafter(a, b) == b:
        return None
    x = a / 2 + b / 2
    return x if a < x < b else float(np.nextafter(a, b))


@dataclass(frozen=True)
class Fold:
    """A fold over ``columns`` (numbers) of the rows of each series in ``order``.

    ``fresh`` names a flag of rows that do not hang on the row before; the first row of a series never does.  With
    ``numbered`` the last column of ``series`` is a running number, and short series of one number range share a call.
    """

    kind: Ride | Settling
    series: Sequence[str]
    order: Sequence[str]
    columns: Sequence[str]
    fresh: str
    numbered: bool = False

    SUMMARY = "fixed double, rows bigint, at array<bigint>, below array<double>, above array<double>, seen array<array<double>>"

    def states(self, df: DataFrame, name: str, rows_per_block: int | None = ROWS_PER_BLOCK) -> DataFrame:
        """Add the state after each row as ``name`` (double)."""
        keys, order, kind, columns, fresh = list(self.series), list(self.order), self.kind, list(self.columns), self.fresh
        numbered, number = self.numbered, self.series[-1]
        rows = with_blocks(df, keys, order[0], rows_per_block)
        blocked = BLOCK in rows.columns

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([number, *order] if numbered else order, kind="stable", ignore_index=True)
            starts = np.array(pdf[fresh], bool)
            state = pdf["_entry"].iat[0] if blocked else np.nan
            starts[0] |= np.isnan(state)
            if numbered:
                numbers = pdf[number].to_numpy()
                starts[1:] |= numbers[1:] != numbers[:-1]
            out = []
            for start, *row in zip(starts.tolist(), *[pdf[c].tolist() for c in columns]):
                state = kind.fresh(*row) if start else kind.next(state, *row)
                out.append(state)
            pdf[name] = np.asarray(out, float)
            return pdf.drop(columns="_entry") if blocked else pdf

        call = [*keys[:-1], "_call"] if numbered else keys

        def dealt(df: DataFrame) -> DataFrame:
            return df.withColumn("_call", call_bucket(number)) if numbered else df

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = np.nan
            for batch in batches:
                seen = dict(zip(batch.schema.names, batch.columns))
                starts = seen.pop("_first").to_numpy(zero_copy_only=False) | seen[fresh].to_numpy(zero_copy_only=False)
                found = kind.all_states(state, starts, *[seen[c].to_numpy(zero_copy_only=False) for c in columns])
                if len(found):
                    state = float(found[-1])
                yield pa.record_batch([*seen.values(), pa.array(found)], [*seen, name])

        if not blocked and hasattr(kind, "all_states"):
            # series come sorted through the tasks, as the scans before left them
            first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
            return df.withColumn("_first", first).mapInArrow(stream, f"{df.schema.simpleString()[7:-1]},`{name}`:double")
        if not blocked:
            return map_series(dealt(df), call, order[0], fold, f"{df.schema.simpleString()[7:-1]},`{name}`:double")
        rows = stage(rows)
        entries = self._entries(rows.filter(F.col(BLOCK).isNotNull()).select(*dict.fromkeys([*keys, BLOCK, *order, fresh, *columns])))
        entered = null_safe_left(rows, entries, [*keys, BLOCK])
        own = F.when(F.col(BLOCK).isNotNull(), F.col(number))
        folded = map_series(dealt(entered).withColumn("_own", own), [*call, "_own", BLOCK], order[0], fold, f"{rows.schema.simpleString()[7:-1]},`{name}`:double")
        return folded if BLOCK in df.columns else folded.drop(BLOCK)

    def _entries(self, large: DataFrame) -> DataFrame:
        """The state with which each block of a large series is entered, null for the first one."""
        keys, order, kind, columns, fresh = list(self.series), list(self.order), self.kind, list(self.columns), self.fresh
        seen = [F.col(c).cast("double") for c in columns]
        # greatest and least skip nulls, but need two columns
        ends = large.groupBy(*keys).agg(
            F.min(BLOCK).alias("_least_block"), F.min(F.least(*seen, seen[0])).alias("_least_value"), F.max(F.greatest(*seen, seen[0])).alias("_most_value")
        )

        def summarise(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, kind="stable", ignore_index=True)
            starts = np.array(pdf[fresh], bool)
            starts[0] |= bool(key[-1] == pdf["_least_block"].iat[0])
            made = kind.summary(starts, [pdf[c].to_numpy() for c in columns], (pdf["_least_value"].iat[0], pdf["_most_value"].iat[0]))
            return pd.DataFrame([{**dict(zip([*keys, BLOCK], key)), **made}])

        def walk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(BLOCK, ignore_index=True)
            state, entries = np.nan, []
            for block in pdf.to_dict("records"):
                entries.append(state)
                state = kind.leave(state, block)
            return pdf[[*keys, BLOCK]].assign(_entry=np.asarray(entries, float))

        kinds = ", ".join(f"`{c}` {t}" for c, t in large.dtypes if c in (*keys, BLOCK))
        summaries = null_safe_left(large, ends, keys).groupBy(*keys, BLOCK).applyInPandas(summarise, f"{kinds}, {self.SUMMARY}")
        return stage(summaries.groupBy(*keys).applyInPandas(walk, f"{kinds}, _entry double"))
