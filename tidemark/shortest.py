"""Cheapest path through a chain of rows with a few states each.

``costs`` holds one cost per state and row, and moving from state ``j`` to
state ``k`` costs ``T[j, k]``.  A plain series is solved in one pass.  A large
one is cut into blocks: each block reduces to a matrix of cheapest costs from
the state before it to its last state; multiplying these (with + and min)
gives the costs at every block start, from which the blocks find their own
back pointers at once and a short backward walk fixes the state at each end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.chain import map_series
from tidemark.scan import BLOCK
from tidemark.session import stage

Moves = Callable[[pd.DataFrame, int], np.ndarray]


def _pass(costs: np.ndarray, moves: Callable[[int], np.ndarray], start: np.ndarray | None, cost_first: bool):
    """Final costs and back pointers of one stretch; ``start`` is NULL for a first row."""
    now, back = start, []
    for i, cost in enumerate(costs):
        if now is None:
            now = cost
            back.append(np.zeros(len(cost), dtype=int))
            continue
        step = now[:, None] + cost[None, :] + moves(i) if cost_first else now[:, None] + moves(i) + cost[None, :]
        best = step.argmin(axis=0)
        back.append(best)
        now = step[best, np.arange(len(cost))]
    return now, back


def _states(back: list[np.ndarray], last: int) -> list[int]:
    path = [last]
    for pointers in reversed(back[1:]):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def cheapest_states(
    df: DataFrame, series: Sequence[str], order: str, costs: str, moves: Moves, cost_first: bool = False,
    name: str = "state",
) -> DataFrame:
    """Add the state of every row on the cheapest path; the first one on ties.

    ``order`` numbers the rows of a series from 1.  ``moves(rows, i)`` gives the
    move matrix into row number ``i`` and may read columns that are constant
    within a series.
    """
    keys = list(series)
    schema = df.schema.simpleString()[7:-1] + f",{name}:bigint"

    def prepare(pdf):
        pdf = pdf.sort_values(order, ignore_index=True)
        first = int(pdf[order].iat[0])
        return pdf, np.vstack(pdf[costs].to_numpy()), lambda i: moves(pdf, first + i)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, table, move = prepare(pdf)
        final, back = _pass(table, move, None, cost_first)
        pdf[name] = np.array(_states(back, int(final.argmin())), dtype="int64")
        return pdf

    if BLOCK not in df.columns:
        return map_series(df, keys, order, solve, schema)

    df = stage(df)
    plain = map_series(df.filter(F.col(BLOCK).isNull()), keys, order, solve, schema)
    large = df.filter(F.col(BLOCK).isNotNull())
    groups = [*keys, BLOCK]
    types = dict(df.dtypes)
    key_shape = ", ".join(f"{c} {types[c]}" for c in groups)

    def labelled(pdf, **columns):
        return pd.DataFrame({**{c: [pdf[c].iat[0]] for c in groups}, **{k: [v] for k, v in columns.items()}})

    def reduce_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, table, move = prepare(pdf)
        m = table.shape[1]
        if pdf[order].iat[0] == 1:
            matrix = np.tile(_pass(table, move, None, cost_first)[0], (m, 1))
        else:
            unit = np.full((m, m), np.inf)
            np.fill_diagonal(unit, 0.0)
            matrix = np.stack([_pass(table, move, unit[j], cost_first)[0] for j in range(m)])
        return labelled(pdf, matrix=matrix.ravel().tolist())

    def carry_forward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK, ignore_index=True)
        before, rows = None, []
        for matrix in pdf["matrix"]:
            m = int(round(len(matrix) ** 0.5))
            matrix = np.array(matrix).reshape(m, m)
            rows.append([] if before is None else before.tolist())
            before = matrix[0] if before is None else (before[:, None] + matrix).min(axis=0)
        pdf["start"] = rows
        return pdf[[*groups, "start"]]

    def point_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, table, move = prepare(pdf)
        start = np.array(pdf["_start"].iat[0])
        final, back = _pass(table, move, start if len(start) else None, cost_first)
        entry = [int(back[0][_states(back, k)[0]]) for k in range(table.shape[1])]
        return labelled(pdf, entry=entry, final=final.tolist())

    def walk_back(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK, ignore_index=True)
        state, ends = int(np.argmin(pdf["final"].iat[-1])), []
        for entry in pdf["entry"][::-1]:
            ends.append(state)
            state = int(entry[state])
        pdf["last_state"] = ends[::-1]
        return pdf[[*groups, "last_state"]]

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, table, move = prepare(pdf)
        start = np.array(pdf["_start"].iat[0])
        _, back = _pass(table, move, start if len(start) else None, cost_first)
        pdf[name] = np.array(_states(back, int(pdf["_last"].iat[0])), dtype="int64")
        return pdf.drop(columns=["_start", "_last"])

    matrices = large.groupBy(*groups).applyInPandas(reduce_block, f"{key_shape}, matrix array<double>")
    starts = stage(matrices.groupBy(*keys).applyInPandas(carry_forward, f"{key_shape}, start array<double>"))
    begun = large.join(starts.withColumnRenamed("start", "_start"), groups)
    pointers = begun.groupBy(*groups).applyInPandas(point_back, f"{key_shape}, entry array<bigint>, final array<double>")
    ends = pointers.groupBy(*keys).applyInPandas(walk_back, f"{key_shape}, last_state bigint")
    done = begun.join(ends.withColumnRenamed("last_state", "_last"), groups)
    return plain.unionByName(done.groupBy(*groups).applyInPandas(finish, schema))
