"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with the same set are one node. A node lists its n-grams by an order in which frequent ones come last (a
sketch of fixed size tells them), and only the first part enters the incidence, which is as long as the bound on the
overlap of a linked pair leaves necessary. The product then goes column by column: in large columns first each node against a
few leaders, which joins groups of near copies without their pairs; what is left are columns that hold several
components, and their products are taken in blocks. Overlap counts are added up, pairs below the bound that their
sizes and places in the lists give are discarded, and the rest are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.base import SLICE, WordIds, documents, list_array, prepare, query, shingles, signed, texts_of
from tidemark.llm.tables import written

#: Least similarity, as a fraction.
NUM, DEN = 75, 100
#: Cells of the frequency sketch, as a power of two, and parts it is added up in.
SKETCH_BITS, SKETCH_PARTS = 20, 64
#: Rows of a column that one task multiplies with the column.
BLOCK = 256
#: A column may be very large if its cell of the sketch holds this many times the mean and this much more; tasks it is dealt to.
OFTEN, OFTEN_LEAST, SALTS = 8, 1_000, 64
#: Turns of leaders in large columns, and leaders that a node is compared with in each.
TURNS, LEADERS = 3, 3
#: Rows from which a column is large.
LARGE = 16
#: Sets remembered in a task, so that copies are listed once.
MOST_SEEN = 200_000
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of ``n`` with any set that it is linked with."""
    return -(-NUM * n // DEN)


def gram_set(words: WordIds, text: bytes, size: int) -> tuple[np.ndarray, list[bytes]]:
    own = text.translate(_UPPER).split()
    return np.unique(shingles(words.of(own), size)), own


def names_of_set(grams: np.ndarray, own: list[bytes]) -> tuple[int, int]:
    """Two names of a set; of the words themselves where it has one member."""
    data = b" ".join(own) if len(grams) == 1 else grams.tobytes()
    return xxhash.xxh3_64_intdigest(data, 1), xxhash.xxh3_64_intdigest(data, 2)


def sets_and_sketch(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (part -1: key, n, s1, s2) and one for each part of a task's sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sketch = WordIds(), np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["part", "key", "n", "s1", "s2", "cells"]
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = []
                for text in texts_of(batch):
                    grams, own = gram_set(words, text, size)
                    s1, s2 = names_of_set(grams, own) if len(grams) else (0, 0)
                    rows.append((len(grams), s1, s2))
                    # members are distinct, but cells may repeat
                    np.add.at(sketch, (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                n, s1, s2 = (np.asarray(c, k) for c, k in zip(zip(*rows), (np.int64, np.uint64, np.uint64)))
                m = batch.num_rows
                yield pa.record_batch([pa.array(np.full(m, -1, np.int32)), batch.column(0), pa.array(n), pa.array(signed(s1)), pa.array(signed(s2)), pa.nulls(m, pa.binary())], names)
        parts = sketch.reshape(SKETCH_PARTS, -1)
        none = pa.nulls(SKETCH_PARTS, pa.int64())
        yield pa.record_batch([pa.array(np.arange(SKETCH_PARTS, dtype=np.int32)), none, none, none, none, pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return docs.mapInArrow(run, "part int, key long, n long, s1 long, s2 long, cells binary")


def added_up(rows: DataFrame) -> np.ndarray:
    """The whole sketch, of fixed size."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(c, np.uint32).astype(np.int64) for c in pdf["cells"]), np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64))
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "cells": [total.astype(np.int64).tobytes()]})

    found = rows.where("part >= 0").select("part", "cells").groupBy("part").applyInPandas(add, "part int, cells binary").collect()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    step = len(sketch) // SKETCH_PARTS
    for r in found:
        sketch[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["cells"], np.int64)
    return sketch


def incidence(docs: DataFrame, sketch: np.ndarray, size: int) -> DataFrame:
    """(gram, node, n, pos, often) of the first part of each node's list.

    ``pos`` counts from 1; ``often`` marks columns that may have very many rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    limit = OFTEN * sketch.mean() + OFTEN_LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, often = WordIds(), set(), shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                parts, nodes, sizes, many = [], [], [], []
                for text in texts_of(whole.slice(at, SLICE)):
                    grams, own = gram_set(words, text, size)
                    if not len(grams):
                        continue
                    node = names_of_set(grams, own)[0]
                    if node in seen:
                        continue
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(node)
                    first = len(grams) - least_overlap(len(grams)) + 1
                    count = often[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.lexsort((grams, count))[:first]
                    parts.append(grams[order])
                    many.append(count[order] > limit)
                    nodes.append(node)
                    sizes.append(len(grams))
                long = [len(p) for p in parts]
                gram = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
                node = np.repeat(np.asarray(nodes, np.uint64), long)
                pos = np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in long]) if long else np.zeros(0, np.int32)
                sized = np.repeat(np.asarray(sizes, np.int32), long)
                yield pa.record_batch([pa.array(signed(gram)), pa.array(signed(node)), pa.array(sized), pa.array(pos), pa.array(np.concatenate(many) if many else np.zeros(0, bool))], ["gram", "node", "n", "pos", "often"])

    return docs.mapInArrow(run, "gram long, node long, n int, pos int, often boolean")


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, n, grams) of the texts of (node, text) that have the node's set; an id may have other texts beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                own = [(node, gram_set(words, t, size)) for node, t in zip(batch.column(0).to_pylist(), texts_of(batch))]
                own = [(node, grams) for node, (grams, text) in own if len(grams) and names_of_set(grams, text)[0] == node % (1 << 64)]
                sets = [signed(grams) for _, grams in own]
                yield pa.record_batch([pa.array([node for node, _ in own], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), list_array(sets)], ["node", "n", "grams"])

    return docs.select("node", "text").mapInArrow(run, "node long, n int, grams array<long>")


def compatible(a: Column, b: Column) -> Column:
    """Whether sizes leave the similarity possible."""
    return F.least(a, b) * DEN >= F.greatest(a, b) * NUM


def wanted(a: Column, b: Column) -> Column:
    """Least overlap of linked sets of these sizes."""
    return F.ceil((a + b) * NUM / F.lit(NUM + DEN))


def reaches(n: Column, pos: Column, other: Column) -> Column:
    """Whether a set can have its first common member with a linked set of size ``other`` at this place of its list."""
    return n - pos + 1 >= wanted(n, other)


def mixed_columns(held: DataFrame) -> DataFrame:
    """(gram, node, n, pos, root, blocks) of the columns with several components, as far as a pair can begin there.

    The smaller set of a pair (either, of one size) begins within the part that its own size gives, the larger one within
    the part that the smallest of the column gives. ``blocks`` is the number of blocks of the column.
    """
    begins = reaches(F.col("n"), F.col("pos"), F.col("n"))
    several = held.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(begins, F.col("n"))).alias("least"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    several = several.where("low != high AND least IS NOT NULL").select("gram", "least", "blocks")
    return held.join(several, "gram").where(reaches(F.col("n"), F.col("pos"), F.col("least"))).drop("least")


def products(mixed: DataFrame) -> DataFrame:
    """(a, b, na, nb, pa, pb) for every common member of a pair of two components at which the pair can begin.

    ``a`` is the smaller set. Lists have one order, so the members in front of the first common one are lost to the overlap.
    A linked pair has its first common member here, and every further one up to the last that is here.
    """
    begins = reaches(F.col("n"), F.col("pos"), F.col("n"))
    left = mixed.where(begins).select("gram", *[F.col(c).alias(d) for c, d in (("node", "a"), ("n", "na"), ("root", "ra"), ("pos", "pa"))], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = mixed.select("gram", *[F.col(c).alias(d) for c, d in (("node", "b"), ("n", "nb"), ("root", "rb"), ("pos", "pb"))], F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    within = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1 >= wanted(F.col("na"), F.col("nb"))
    rows = left.join(right, ["gram", "block"]).where(ordered & (F.col("ra") != F.col("rb")) & compatible(F.col("na"), F.col("nb")) & within)
    return rows.select("a", "b", "na", "nb", "pa", "pb")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("_ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("_gb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("_ga", "_gb"))
    return both.select("a", "b", common.alias("o"), (F.size("_ga") + F.size("_gb") - common).alias("u")).where(DEN * F.col("o") >= NUM * F.col("u")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge; root is the smallest node reachable.

    Large and small stars in turn: every node points its larger neighbours, then its smaller ones, to the least it
    knows, until nothing changes.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())

    def stars(e: DataFrame, large: bool) -> DataFrame:
        ends = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        rows = ends.join(least, "u")
        out = rows.where(F.col("v") > F.col("u")) if large else rows.where(F.col("v") != F.col("m"))
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return written(out.where("u > v").distinct())

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e, before = written(e), None
    while (now := state(e)) != before:
        before = now
        e = stars(stars(e, True), False)
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, size: int = 5) -> DataFrame:
    """Class of every document under links of similar shingle sets.

    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included). A null text or one without words
    has no shingles and is linked with nothing. Rows of one doc_id are one document in as many texts: each row gets the
    class of its own text. A null doc_id gives a null component and links nothing. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    known = written(sets_and_sketch(rows, size))
    sketch = added_up(known)
    nodes = known.where("part < 0").select("key", "n", "s1", "s2")
    # a node goes by its first name; two sets of one first name would be taken for each other
    reps = nodes.where("n > 0 AND key IS NOT NULL").groupBy("s1").agg(F.min("key").alias("rep"), F.min("s2").alias("low"), F.max("s2").alias("high"))
    reps = written(reps)
    if reps.where("low != high").limit(1).count():
        raise ValueError("two sets have one name; give the names another seed")
    reps = reps.select(F.col("s1").alias("node"), "rep")
    sound = rows.where("key IS NOT NULL")
    repeated = not nodes.where("key IS NOT NULL").groupBy("key").count().where("count > 1").isEmpty()

    # columns that may be very large are dealt to several tasks by node, and what each found is put together
    table = incidence(sound.select("text"), sketch, size)
    table = table.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0)).repartition("gram", "salt")
    column = Window.partitionBy("gram", "salt")
    lead = F.min("node").over(column)
    found = table.select("gram", "node", "n", "pos", "often", lead.alias("lead"), F.max("node").over(column).alias("last"), F.count("*").over(column).alias("c"))
    found = written(found.where(F.col("often") | (F.col("lead") != F.col("last"))))
    often = found.where("often")
    whole = often.groupBy("gram").agg(F.min("lead").alias("lead"), F.max("last").alias("last"), F.count("*").alias("c")).where(F.col("lead") != F.col("last"))
    kept = ("gram", "node", "n", "pos", "c")
    shared = found.where("NOT often").select(*kept).unionByName(often.drop("lead", "last", "c").join(whole, "gram").select(*kept))
    shared = written(shared.distinct())

    def sets(wanted: DataFrame) -> DataFrame:
        """Whole sets of some nodes."""
        texts = sound.join(wanted.distinct().join(reps, "node").select("node", F.col("rep").alias("key")), "key")
        found = whole_sets(texts, size)
        # only rows of one id can give a node twice
        return written(found.dropDuplicates(["node"]) if repeated else found)

    # in large columns each node against a few leaders, again and again with other leaders for the nodes that are left
    large = written(shared.where(F.col("c") >= LARGE).select("gram", "node", "n", "pos"))
    pool, links, joined = sets(large.select("node")), None, None
    for turn in range(TURNS):
        rooted = large.select("*", F.col("node").alias("root")) if joined is None else large.join(joined, "node", "left").select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
        # few rare n-grams in front of a column's are a mark of the middle of a group of near copies
        front = F.lit(0) if turn else F.col("pos")
        leader = F.min(F.struct(front.alias("f"), F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb")))
        per_gram = rooted.groupBy("gram").agg(leader.alias("l"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram", "l.b", "l.nb", "l.rb")
        met = rooted.join(per_gram, "gram").where((F.col("root") != F.col("rb")) & compatible(F.col("n"), F.col("nb"))).groupBy("node", "b").agg(F.count("*").alias("c"))
        # a node has no more leaders than columns; it is compared with those it meets most often
        most = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "b")), asc=False), 1, LEADERS).alias("l"))
        pairs = written(most.select(F.col("node").alias("a"), F.explode("l.b").alias("b")))
        new = written(linked(pairs, pool))
        links = new if links is None else links.unionByName(new)
        joined = components(links)

    # columns that hold several components, multiplied in blocks
    held = shared.select("gram", "node", "n", "pos").join(joined, "node", "left").select("gram", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    mixed = written(mixed_columns(held))
    overlap = products(mixed).groupBy("a", "b").agg(F.count("*").alias("c"), *[F.max(x).alias(x) for x in ("na", "nb", "pa", "pb")])
    # all common members up to the last one found are counted, and behind it one set has no more than is left
    more = written(overlap.where(F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= wanted(F.col("na"), F.col("nb"))).select("a", "b"))
    links = links.unionByName(linked(more, sets(more.select(F.col("a").alias("node")).distinct().unionByName(more.select(F.col("b").alias("node")).distinct()))))

    named = links.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
    roots = components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).withColumnRenamed("node", "rep")
    classes = reps.join(roots, "rep", "left").select(F.col("node").alias("s1"), F.coalesce("root", "rep").alias("root"))
    out = nodes.join(classes, "s1", "left")
    component = F.when(F.col("key").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("root")).otherwise(F.col("key"))
    return out.select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


#: Shingle sets and classes over a relation ``{docs}`` (doc_id, text): relation ``classes``.
CLASSES_SQL = r"""
 wd AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
 sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM wd, range(1, greatest(len(w) - 4, least(len(w), 1)) + 1) r(i)),
 sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
 lk AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b USING (g) JOIN sz p ON p.doc_id = a.doc_id JOIN sz q ON q.doc_id = b.doc_id
        WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
 rc AS (SELECT doc_id, doc_id AS root FROM wd UNION SELECT lk.b, rc.root FROM rc JOIN lk ON lk.a = rc.doc_id AND rc.root < lk.b),
 classes AS (SELECT wd.doc_id, coalesce(sz.n, 0) AS n_shingles, min(root) AS component_id FROM wd LEFT JOIN sz USING (doc_id) JOIN rc USING (doc_id) GROUP BY 1, 2)"""


@query(sql=f"WITH RECURSIVE {CLASSES_SQL.format(docs='documents')} SELECT * FROM classes")
def op2_ngram_join(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))
