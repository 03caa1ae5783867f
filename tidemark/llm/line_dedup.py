"""Line deduplication against levelled sorted runs of line hashes.

A run is a bucketed table, sorted by hash: a row per line hash with the number of its documents, the largest of them
and whether the hash was new when the run was made. A batch of documents becomes a run of its own: its hashes are
merge-anti-joined with the runs there are, which share their buckets, so only the batch is shuffled. When a level
holds ``fan`` runs they are compacted into one of the next level. A line hash has 128 bits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.base import documents, query
from tidemark.llm.tables import written

#: What is stripped at both ends of a line, and the letters that are folded.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hash_pair(key: Column) -> tuple[Column, Column]:
    # the seed comes first, else the second hash would follow from the first
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class Runs:
    """Levelled runs of line hashes; each run a table in the warehouse."""

    KEY = ("h1", "h2")

    def __init__(self, spark: SparkSession, fan: int = 2, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def _store(self, rows: DataFrame) -> str:
        self.made += 1
        name = f"{self.name}_{self.made}"
        rows = rows.repartition(self.buckets, *self.KEY)
        rows.write.bucketBy(self.buckets, *self.KEY).sortBy(*self.KEY).format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n) for level in self.levels for n in level]

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged two by two along their buckets, without an exchange."""
        while len(runs) > 1:
            left, right = runs[0], runs[1].select(*self.KEY, *[F.col(c).alias(f"_{c}") for c in ("docs", "last", "fresh")])
            both = left.join(right, list(self.KEY), "full_outer")
            docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
            fresh = F.coalesce("fresh", F.lit(False)) | F.coalesce("_fresh", F.lit(False))
            runs = [both.select(*self.KEY, docs.alias("docs"), F.greatest("last", "_last").alias("last"), fresh.alias("fresh")), *runs[2:]]
        return runs[0]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add the (h1, h2, docs, last) of one batch, a row per hash; returns its run with ``fresh`` for hashes no run had.

        A document must be in one batch only.
        """
        known = self.runs()
        rows = batch.repartition(self.buckets, *self.KEY)
        fresh = rows
        for r in known:
            fresh = fresh.join(r.select(*self.KEY), list(self.KEY), "left_anti")
        rows = rows.withColumn("fresh", F.lit(not known))
        if known:
            # a fresh hash is in one run as fresh; elsewhere it counts documents only
            new = fresh.select(*self.KEY, F.lit(True).alias("new"))
            rows = rows.drop("fresh").join(new, list(self.KEY), "left").select(*batch.columns, F.coalesce("new", F.lit(False)).alias("fresh"))
        name = self._store(rows)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        added, level = self.spark.table(name), 0
        while len(self.levels[level]) >= self.fan:
            full = self.levels[level]
            one = self._store(self._merged([self.spark.table(n) for n in full]))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level] = []
            self.levels[level + 1].append(one)
            level += 1
        return added

    def all(self) -> DataFrame:
        """A row per hash over all runs."""
        return self._merged(self.runs())

    def drop(self) -> None:
        for i in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")


def drop_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5, batches: int = 4, fan: int = 2) -> DataFrame:
    """``docs`` with ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``.

    A line's key of ``least_length`` code points or more, found in at least ``least_docs`` documents, loses all its
    lines but those in the largest doc_id that holds it. A null or empty text is one empty line. Rows of one doc_id
    count as one document and are rewritten each; a row without doc_id counts for no line and keeps all. Input columns of
    the names added here are replaced.
    """
    spark = docs.sparkSession
    key = line_key(F.col("line"))
    h1, h2 = hash_pair(F.col("key"))
    long_ones = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(lines_of(F.col("text"))).alias("line")).select("doc_id", key.alias("key")).where(F.length("key") >= least_length)
    held = long_ones.select(h1.alias("h1"), h2.alias("h2"), "doc_id").distinct()
    held = written(held.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")), "batch")
    runs = Runs(spark, fan)
    for b in range(batches):
        own = held.where(F.col("batch") == b)
        runs.add(own.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")))
    common = written(runs.all().where(F.col("docs") >= least_docs).select("h1", "h2", "last"))
    runs.drop()
    lost = held.join(common, ["h1", "h2"]).where(F.col("doc_id") != F.col("last"))
    lost = lost.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("_lost"))

    def stays(line: Column) -> Column:
        k = line_key(line)
        a, b = hash_pair(k)
        return (F.length(k) < least_length) | ~F.array_contains(F.col("_lost"), F.struct(a.alias("h1"), b.alias("h2")))

    added = ("kept", "n_lines", "n_dropped", "_lost", "_kept")
    rows = docs.drop(*added).join(lost, "doc_id", "left")
    rows = rows.withColumn("_kept", F.when(F.col("_lost").isNotNull(), F.filter(lines_of(F.col("text")), stays)))
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return rows.select(
        *[F.col(c) for c in docs.columns if c not in added],
        F.coalesce(F.array_join("_kept", "\n"), F.col("text"), F.lit("")).alias("kept"), n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size("_kept"), F.lit(0)).cast("long").alias("n_dropped"),
    )


_KEY_SQL = f"translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '{UPPER}', '{LOWER}')"
#: Rows of the line rule: doc_id, kept, n_lines, n_dropped over a relation ``{docs}``.
LINES_SQL = f"""
 ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM {{docs}}),
 ks AS (SELECT doc_id, pos, line, {_KEY_SQL} AS k FROM ls),
 hot AS (SELECT k, max(doc_id) AS last FROM ks WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
 st AS (SELECT ks.*, coalesce(hot.last = ks.doc_id, true) AS stays FROM ks LEFT JOIN hot USING (k)),
 kept_lines AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS kept,
           count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped FROM st GROUP BY doc_id)"""


@query(sql=f"WITH {LINES_SQL.format(docs='documents')} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept_lines")
def op9_line_dedup(spark, sf_dir):
    rows = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
