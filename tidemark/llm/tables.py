"""Intermediate tables in the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemark.session import checkpoint_dir


#: Spark's setting by which the files of a query's exchanges go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def apart(df: DataFrame) -> DataFrame:
    """``df`` written as a table by a query that leaves no files of its exchanges; what follows reads stored rows alone."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as a table written to the shared folder, so that what follows starts from stored rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
