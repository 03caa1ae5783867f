"""Greedy chains over a series: from each chosen row on to the first one in reach.

Many left-to-right rules pick rows like this: after a chosen row only the next
row at or beyond ``reach`` counts.  Which row follows depends on the row alone,
so a large series is solved in three steps: every block tells for its possible
entry rows where the chain leaves it, a short walk over the blocks finds the
actual entry of each, and the blocks mark their rows independently.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.scan import BLOCK, null_safe_left
from tidemark.session import stage


# Groups of consecutive runs that share one call; a run has a small fixed bound.
RUNS_PER_CALL = 256


def run_slices(ids: np.ndarray) -> list[slice]:
    """Slices of equal neighbours in a sorted array."""
    edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def call_bucket(run: str) -> Column:
    """Number of the call that works a run."""
    return F.floor(F.col(run) / RUNS_PER_CALL)


def map_series(
    df: DataFrame, series: Sequence[str], order: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | StructType
) -> DataFrame:
    """``fn`` on the rows of each series, as grouped ``applyInPandas``, without a call of Spark's for every small series.

    Series come sorted through the tasks and are cut where a new one begins; a task holds a batch and the largest series.
    """
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    target, names = to_arrow_schema(kind), df.columns
    rows = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*series).orderBy(order)))

    def work(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        at = [*np.flatnonzero(table["_nth"].to_numpy() == 1).tolist(), len(table)]
        table = table.select(names)
        # with NULLs among them numbers and flags get other types, so such columns are turned series by series
        mixed = any((pa.types.is_integer(f.type) or pa.types.is_boolean(f.type)) and table[f.name].null_count for f in table.schema if f.name != BLOCK)
        whole = None if mixed else table.to_pandas()
        found = []
        for a, b in zip(at, at[1:]):
            out = fn(table.slice(a, b - a).to_pandas() if mixed else whole.iloc[a:b])
            if len(out):
                found.append(pa.Table.from_pandas(out, target, preserve_index=False) if mixed else out)
        if found:
            both = pa.concat_tables(found) if mixed else pa.Table.from_pandas(pd.concat(found), target, preserve_index=False)
            yield from both.to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("_nth").to_numpy(zero_copy_only=False) == 1)
            if len(starts):
                last = int(starts[-1])
                ready = [*held, batch.slice(0, last)]
                if sum(map(len, ready)):
                    yield from work(ready)
                held = []
                batch = batch.slice(last)
            held.append(batch)
        if sum(map(len, held)):
            yield from work(held)

    return rows.mapInArrow(run, kind)


def _followers(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("_pos", kind="stable", ignore_index=True)
    at = pdf["_pos"].to_numpy()
    reach = pdf["_jump"].to_numpy()
    if "_span" in pdf and len(at) and (reach - at > pdf["_span"].iat[0]).any():
        raise ValueError(f"a row reaches further than the span of {pdf['_span'].iat[0]}")
    return pdf, at, np.maximum(np.searchsorted(at, reach), np.arange(1, len(at) + 1))


def _leave(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reach with which the chain leaves the block, for each possible entry row."""
    pdf, at, following = _followers(pdf)
    leave = pdf["_jump"].to_numpy().copy()
    for i in range(len(at) - 1, -1, -1):
        if following[i] < len(at):
            leave[i] = leave[following[i]]
    pdf["_leave"] = leave
    near = np.searchsorted(at, at[0] + pdf["_span"].iat[0], side="right") + 1
    return pdf.iloc[:near]


def _walk_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Reach with which the chain enters each block of one series."""
    pdf = pdf.sort_values([BLOCK, "_pos"], ignore_index=True)
    reach = pdf["_first_jump"].iat[0]
    rows = []
    for _, part in pdf.groupby(BLOCK, sort=True):
        rows.append((*part.iloc[0][[c for c in part.columns if c.startswith("_k")]], part[BLOCK].iat[0], reach))
        i = int(np.searchsorted(part["_pos"].to_numpy(), reach))
        if i < len(part):
            reach = part["_leave"].iat[i]
    names = [c for c in pdf.columns if c.startswith("_k")]
    return pd.DataFrame(rows, columns=[*names, BLOCK, "_enter"])


def _mark(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, at, following = _followers(pdf)
    chosen = []
    i = int(np.searchsorted(at, pdf["_enter"].iat[0]))
    while i < len(at):
        chosen.append(i)
        i = following[i]
    return pdf.iloc[chosen]


def greedy_chain(
    df: DataFrame, series: Sequence[str], position: str, reach: str, root: str, span: float
) -> DataFrame:
    """Rows of ``df`` on the chain of each series.

    The chain starts at the first row with ``position >= root`` and goes on to
    the first row with ``position >= reach`` of the row before.  ``root`` is
    constant within a series, and ``reach`` lies at most ``span`` beyond
    ``position``.  With a block column from ``with_blocks``, large series are
    marked block by block.
    """
    keys = list(series)
    nodes = df.select(
        *df.columns,
        F.col(position).cast("double").alias("_pos"),
        F.col(reach).cast("double").alias("_jump"),
        F.col(root).cast("double").alias("_enter"),
    )
    groups = keys
    if BLOCK in df.columns:
        groups = [*keys, BLOCK]
        nodes = stage(nodes)
        k = [f"_k{i}" for i in range(len(keys))]
        large = nodes.filter(F.col(BLOCK).isNotNull()).select(
            *[F.col(c).alias(a) for c, a in zip(keys, k)],
            BLOCK,
            "_pos",
            "_jump",
            F.col("_enter").alias("_first_jump"),
            F.lit(float(span)).alias("_span"),
        )
        types = {f.name: f.dataType.simpleString() for f in large.schema.fields}
        shape = ", ".join(f"{c} {types[c]}" for c in large.columns)
        exits = large.groupBy(*k, BLOCK).applyInPandas(_leave, f"{shape}, _leave double")
        entries = exits.groupBy(*k).applyInPandas(
            _walk_blocks, ", ".join(f"{c} {types[c]}" for c in [*k, BLOCK]) + ", _enter double"
        )
        entries = entries.select(
            *[F.col(a).alias(c) for c, a in zip(keys, k)], BLOCK, F.col("_enter").alias("_block_enter")
        )
        nodes = null_safe_left(nodes, entries, groups).select(
            *df.columns, "_pos", "_jump", F.coalesce("_block_enter", "_enter").alias("_enter")
        )
    return map_series(nodes, groups, "_pos", _mark, nodes.schema).select(*df.columns)
