"""File listings, text documents and paired files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.grid import _c

# Media file extensions.
MEDIA_EXTENSIONS = (".wav", ".mp3", ".flac", ".m4a", ".ogg")


def list_files(
    spark: SparkSession, folder: str, extensions: Sequence[str] = MEDIA_EXTENSIONS, recursive: bool = True
) -> DataFrame:
    """Files by extension without regard to case: ``(path, name, stem, extension, length, content)``.

    ``content`` is only read where a query uses it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1))
    return files.select("path", name.alias("name"), T.stem("path").alias("stem"), extension.alias("extension"), "length", "content").filter(
        F.col("extension").isin(*[e.lower() for e in extensions])
    )


def content_key(stem, content) -> Column:
    """``struct(md5, output_key)``: the key is the stem, blanks as ``_``, and 8 digits of the hash."""
    digest = F.md5(_c(content))
    return F.struct(
        digest.alias("md5"),
        F.concat_ws("_", F.translate(_c(stem), " ", "_"), F.substring(digest, 1, 8)).alias("output_key"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files by stem: ``(stem, text)``; files that cannot be read are left out."""
    texts = (
        spark.read.option("wholetext", "true").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").text(path)
    )
    # the metadata path is URL encoded, where "+" stands for itself
    path_text = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return texts.select(T.stem(path_text).alias("stem"), F.col("value").alias("text"))


def pair_files(media: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media files with the label text of the same stem, and media files without one."""
    pairs = media.join(labels.select("stem", F.col("text").alias("label_text")), "stem", "left")
    return pairs.filter(F.col("label_text").isNotNull()), pairs.filter(F.col("label_text").isNull()).drop("label_text")
