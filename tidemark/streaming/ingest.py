"""Incremental file ingest: each content is processed once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.files import content_key
from tidemark.functions import text as T

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of the files of a folder with hash and output key."""
    files = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true").load(folder)
    )
    key = content_key(T.stem("path"), "content")
    return files.select("path", "modificationTime", "content", key["md5"].alias("md5"), key["output_key"].alias("output_key"))


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def ingest_new(
    files: DataFrame, process: Callable[[DataFrame], DataFrame], manifest: str, output: str, checkpoint: str
) -> StreamingQuery:
    """Run ``process`` on new contents only and record them in the manifest folder.

    A batch writes to its own subfolders, named by the checkpoint and the batch
    number, so a repeated batch replaces its earlier attempt.  A content counts
    as known from all other batches, those of earlier checkpoints included.
    """
    spark = files.sparkSession
    schema = "md5 string, output_key string, path string, run string, batch bigint"
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def batch(df: DataFrame, number: int) -> None:
        once = df.groupBy("md5").agg(F.min_by(F.struct(*[c for c in df.columns if c != "md5"]), "path").alias("_r"))
        once = once.select("md5", "_r.*")
        if exists(spark, manifest):
            known = spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(manifest)
            # a batch that is repeated does not know itself
            others = known.filter((F.col("run") != run) | (F.col("batch") < number))
            once = once.join(others.select("md5"), "md5", "left_anti")
        process(once).write.mode("overwrite").parquet(f"{output}/run={run}/batch={number}")
        record = once.select("md5", "output_key", "path")
        record.write.mode("overwrite").parquet(f"{manifest}/run={run}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
