"""Registration, words and hashes shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: ASCII white space and its complement, in the form of Java and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one slice of an Arrow batch; bounds what a task holds besides the batch.
SLICE = 512


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with SQL for the same result."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


#: Rows of an Arrow batch of whole texts; the session's default of 10,000 would hold too much of long texts.
BATCH = 1_000


def prepare(spark: SparkSession) -> None:
    """This package on the executors, and Arrow batches of a size that long texts bear."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def map_rows(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over small slices of the Arrow batches of ``columns``; other columns are not read."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield fn(batch.slice(at, SLICE))

    return df.select(*columns).mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 texts of a batch; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


class WordIds:
    """64-bit names of words; none is remembered, as hashing a word again takes less than looking it up."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer on 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def factors(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit factors."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FIVE = {size: factors(size, 5) for size in range(1, 65)}


def shingles(ids: np.ndarray, size: int = 5) -> np.ndarray:
    """Names of all runs of ``size`` words; of the whole sequence where it has fewer words."""
    if not len(ids):
        return ids
    size = min(size, len(ids))
    k = _FIVE[size]
    n = len(ids) - size + 1
    total = ids[:n] * k[0]
    for i in range(1, size):
        total = total + ids[i : i + n] * k[i]
    return mixed(total)


def list_array(parts: list[np.ndarray], kind=np.int64) -> pa.ListArray:
    """Arrow list column of numpy arrays."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit names in the form of Spark's long."""
    return x.view(np.int64)
