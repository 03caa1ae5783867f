"""Dictionaries, vocabularies, manifests and timing documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.grid import _c

MANIFEST = "output_key string, source_name string, source_path string, chunks int, labs int"
CHUNKS = "array<struct<index:int,offset:double,duration:double,text:string>>"


def read_dictionary(spark: SparkSession, path: str, separator: str = ":", values: str | None = ",") -> DataFrame:
    """``key<separator>v1,v2`` lines as ``(key, values)``; the last line of a key wins.

    ``values=None`` keeps the value as one element.  Blank lines do not count.
    """
    files = spark.read.option("wholetext", "true").text(path)
    lines = files.select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("line_no", "line"))
    return parse_dictionary(lines, separator, values)


def parse_dictionary(lines: DataFrame, separator: str = ":", values: str | None = ",") -> DataFrame:
    line = F.trim("line")
    parts = F.split(line, rf"\Q{separator}\E", 2)
    rows = lines.filter(line != "").select(
        F.trim(F.get(parts, F.lit(0))).alias("key"), F.trim(F.get(parts, F.lit(1))).alias("_v"), "line_no"
    )
    value = F.array("_v") if values is None else F.split("_v", rf"\Q{values}\E")
    return rows.filter(F.col("_v").isNotNull()).groupBy("key").agg(F.max_by(value, "line_no").alias("values"))


def vocabulary(json) -> Column:
    """``struct(tokens map<int,string>, blank int)`` of a JSON map from token to id."""
    ids = F.from_json(_c(json), "map<string,int>")
    tokens = F.map_from_entries(
        F.transform(F.map_entries(ids), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value")))
    )
    blank = F.coalesce(F.element_at(ids, "<blank>"), F.element_at(ids, "PAD"), F.lit(0))
    return F.struct(tokens.alias("tokens"), blank.alias("blank"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows of JSON files from hash to record; files that are no such map count as empty."""
    files = spark.read.option("wholetext", "true").text(path)
    return parse_manifest(files)


def parse_manifest(files: DataFrame) -> DataFrame:
    records = F.from_json("value", f"map<string,struct<{MANIFEST.replace(' ', ':').replace(',:', ',')}>>")
    return files.select(F.explode(records).alias("md5", "_r")).filter(F.col("_r.output_key").isNotNull()).select("md5", "_r.*")


def timing_rows(df: DataFrame, document: str = "value") -> DataFrame:
    """Chunks of timing documents, an object with ``chunks`` or the bare array."""
    whole = F.from_json(document, f"struct<source:struct<path:string,md5:string>,chunks:{CHUNKS}>")
    bare = F.when(F.ltrim(document).startswith("["), F.from_json(document, CHUNKS))
    others = [c for c in df.columns if c != document]
    rows = df.select(*others, whole["source"].alias("_source"), F.coalesce(bare, whole["chunks"]).alias("_chunks"))
    return rows.select(*others, F.col("_source.path").alias("path"), F.col("_source.md5").alias("md5"), F.inline("_chunks"))


def result_text(result) -> Column:
    """Text of a result that is plain text or JSON with ``text`` or ``transcript``; empty for none."""
    r = _c(result)
    is_object = F.trim(r).startswith("{") & F.from_json(r, "map<string,string>").isNotNull()
    own = F.coalesce(
        F.nullif(F.get_json_object(r, "$.text"), F.lit("")), F.nullif(F.get_json_object(r, "$.transcript"), F.lit(""))
    )
    return F.coalesce(F.when(is_object, F.coalesce(own, F.lit(""))).otherwise(r), F.lit(""))
