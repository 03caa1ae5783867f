"""User functions over batches and series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.scan import Scan, null_safe_left, with_blocks
from tidemark.session import stage


def batched_scores(
    df: DataFrame, column: str, scorer: Callable[[list], list], result_type: str, batch_size: int = 16, name: str = "score",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Score a column in batches of ``batch_size``; a failed batch gives NULLs and its error.

    Rows keep their order; ``scorer`` is pickled once per task.  Of the columns those of ``keep`` come back, all without
    it.  Only the values of one batch are Python objects at a time.
    """
    kept = df.columns if keep is None else list(keep)
    kind = to_arrow_type(StructType.fromDDL(f"score {result_type}")[0].dataType)
    schema = StructType([df.schema[c] for c in kept]).add(name, StructType.fromDDL(f"score {result_type}")[0].dataType).add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values, scores, errors = rows.column(column), [], []
            for at in range(0, len(rows), batch_size):
                part = values.slice(at, batch_size).to_pylist()
                try:
                    found, error = list(scorer(part)), None
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} results for {len(part)} inputs")
                except Exception as problem:
                    found, error = [None] * len(part), f"{type(problem).__name__}: {problem}"
                scores += found
                errors += [error] * len(part)
            scored = pa.array(pd.Series(scores, dtype="object"), kind, from_pandas=True)
            yield pa.record_batch([*[rows.column(c) for c in kept], scored, pa.array(errors, pa.string())], [*kept, name, "error"])

    return df.mapInArrow(run, schema)


def split_segments(
    samples: DataFrame, keys: Sequence[str], segment: str, at: str, value: str, rate: float,
    splitter: Callable[[list], list], block: int | None = None, reach: int = 0,
) -> DataFrame:
    """User splitter on every segment: ``(keys, start, end, offset)`` on the series.

    ``splitter`` gets the values of a segment and returns ``(start, end)`` sample
    pairs inside it that do not overlap; the segment start is added here.

    Without ``block`` a segment is one call.  With it the splitter gets at most
    ``block`` samples and ``reach`` more on both sides at a time, and a start or
    an end counts where it lies in the block itself.  That gives the pieces of
    one call for every splitter that judges each start and end by values no
    further away than ``reach``.
    """
    group = [*keys, segment]
    types = dict(samples.dtypes)
    shape = ", ".join(f"{c} {types[c]}" for c in group)
    begin = F.col(segment)
    if block is None:

        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            values = pdf.sort_values(at)[value].tolist()
            return pd.DataFrame([[*key, a, b] for a, b in splitter(values)])

        pieces = samples.groupBy(*group).applyInPandas(run, f"{shape}, _a bigint, _b bigint")
    else:
        pieces = _split_blocks(samples, group, at, value, splitter, block, reach, shape)
    return pieces.select(
        *keys, (begin + F.col("_a")).alias("start"), (begin + F.col("_b")).alias("end"), ((begin + F.col("_a")) / rate).alias("offset")
    )


def _split_blocks(
    samples: DataFrame, group: Sequence[str], at: str, value: str, splitter: Callable[[list], list], block: int, reach: int,
    shape: str,
) -> DataFrame:
    """Pieces of each segment, put together from the starts and ends that blocks find."""
    sizes = samples.groupBy(*group).agg(F.max(at).alias("_last"))
    first = F.greatest(F.lit(0), F.floor((F.col(at) - reach) / block))
    last = F.least(F.floor(F.col("_last") / block), F.floor((F.col(at) + reach) / block))
    dealt = null_safe_left(samples.select(*group, at, value), sizes, group)
    dealt = dealt.select(*group, at, value, F.explode(F.sequence(first, last)).alias("_block"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        low, begin, end = int(pdf[at].iat[0]), int(key[-1]) * block, (int(key[-1]) + 1) * block
        found = [(low + int(a), low + int(b)) for a, b in splitter(pdf[value].tolist()) if b > a]
        edges = [(a, 1) for a, _ in found if begin <= a < end] + [(b, 0) for _, b in found if begin < b <= end]
        return pd.DataFrame([[*key[:-1], *e] for e in edges], columns=[*group, "_place", "_starts"])

    edges = dealt.groupBy(*group, "_block").applyInPandas(run, f"{shape}, _place bigint, _starts int")
    edges = with_blocks(stage(edges), group, "_place")
    edges = Scan(edges, group, ["_place", "_starts"]).next_valid("_b", F.when(F.col("_starts") == 0, F.col("_place"))).columns()
    return edges.filter("_starts = 1").select(*group, F.col("_place").alias("_a"), "_b")
