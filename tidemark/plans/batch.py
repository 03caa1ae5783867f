"""Batch job over media files: skip what is known, record what is new."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import new_inputs, upsert_latest
from tidemark.sources.files import content_key


def plan_inputs(files: DataFrame, manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files still to be processed, with hash and output key."""
    key = content_key("stem", "content")
    keyed = files.select("path", "name", "stem", "content", key["md5"].alias("md5"), key["output_key"].alias("output_key"))
    open_inputs = new_inputs(keyed, manifest, outputs)
    return open_inputs.join(outputs.select("output_key").distinct(), "output_key", "left_anti")


def record_results(manifest: DataFrame, results: DataFrame, seq: int) -> DataFrame:
    """Manifest after a run; failed results are left out."""
    done = results.filter(F.col("error").isNull()).select(
        "md5", "output_key", F.col("name").alias("source_name"), F.col("path").alias("source_path"), "chunks", "labs",
        F.lit(seq).cast("bigint").alias("seq"),
    )
    return upsert_latest(manifest, done)


def run_summary(files: DataFrame, planned: DataFrame, results: DataFrame) -> DataFrame:
    """Totals of a run: files, skipped, failed, chunks and labels."""
    parts = [
        files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("files").alias("measure"), "n"),
        files.agg(F.count(F.lit(1)).alias("_a")).join(F.broadcast(planned.agg(F.count(F.lit(1)).alias("_b")))).select(
            F.lit("skipped").alias("measure"), (F.col("_a") - F.col("_b")).alias("n")
        ),
        results.agg(F.count_if(F.col("error").isNotNull()).alias("n")).select(F.lit("failed").alias("measure"), "n"),
        results.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n")).select(F.lit("chunks").alias("measure"), "n"),
        results.agg(F.coalesce(F.sum("labs"), F.lit(0)).alias("n")).select(F.lit("labs").alias("measure"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


