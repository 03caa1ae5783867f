"""Uniform shuffle into shards of exact sizes by a communication matrix.

The input's partitions are cut into chunks of at most 2^bits rows. How many rows of each chunk go to each shard is drawn
exactly: given the sizes of chunks and shards, the counts of a uniform random permutation are multivariate
hypergeometric, so a tree over the chunks splits the shards' sizes from the whole table down to single chunks. Each
partition is then permuted where it is, the first rows of a chunk go to shard 0, the next to shard 1 and so on, and
every shard is permuted again behind the exchange.

Everything is built from DataFrame functions. Rows are exchanged once, by shard and block of the second permutation;
blocks are dealt at random, so no value of any column makes a task large.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.base import documents, query
from tidemark.llm.tables import written

#: Children of a node in the tree over the chunks, on average.
FAN = 64
#: Rows of a block of the second permutation, on average.
BLOCK_ROWS = 16_384


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that hangs on ``parts`` alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts]), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``marked`` rows are among ``drawn`` of ``total``, by inversion at ``u``.

    Weights are ratios to the mode's, out to 12 standard deviations, where they are below what a double holds; no
    factorial is computed. Steps grow with the deviation alone.
    """
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    least, most = F.greatest(F.lit(0.0), m + k - n), F.least(m, k)
    mode = F.least(F.greatest(F.floor((m + 1) * (k + 1) / (n + 2)).cast("double"), least), most)
    spread = F.sqrt(F.greatest(m * (k / n) * ((n - k) / n) * ((n - m) / F.greatest(n - 1, F.lit(1.0))), F.lit(0.0)))
    reach = F.ceil(spread * 12).cast("double") + 24
    start = F.struct(
        n.alias("n"), k.alias("k"), m.alias("m"), mode.alias("mode"), u.alias("u"),
        F.least(most - mode, reach).cast("int").alias("up"), F.least(mode - least, reach).cast("int").alias("down"),
    )

    def ratio(s: Column, step: Column, upwards: bool) -> Column:
        """Weight ``step`` places from the mode over the weight of the place before."""
        if upwards:
            x = s["mode"] + step - 1
            return (s["k"] - x) * (s["m"] - x) / ((x + 1) * (s["n"] - s["k"] - s["m"] + x + 1))
        x = s["mode"] - step + 1
        return x * (s["n"] - s["k"] - s["m"] + x) / ((s["k"] - x + 1) * (s["m"] - x + 1))

    def steps(s: Column, upwards: bool) -> Column:
        return F.slice(F.sequence(F.lit(0), s["up" if upwards else "down"]), F.lit(2), s["up" if upwards else "down"])

    def total_of(s: Column, upwards: bool) -> Column:
        def add(at: Column, step: Column) -> Column:
            weight = at["weight"] * ratio(s, step, upwards)
            return F.struct(weight.alias("weight"), (at["sum"] + weight).alias("sum"))

        return F.aggregate(steps(s, upwards), F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum")), add, lambda at: at["sum"])

    def reached(s: Column, goal: Column, upwards: bool) -> Column:
        """Places from the mode at which the running weight passes ``goal``."""

        def walk(at: Column, step: Column) -> Column:
            weight = at["weight"] * ratio(s, step, upwards)
            further = (at["sum"] < goal).cast("int")
            return F.struct(weight.alias("weight"), (at["sum"] + weight).alias("sum"), (at["place"] + further).alias("place"))

        first = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"), F.lit(0).alias("place"))
        return F.aggregate(steps(s, upwards), first, walk, lambda at: at["place"])

    def pick(s: Column) -> Column:
        def by_side(w: Column) -> Column:
            goal = s["u"] * (1 + w["up"] + w["down"])
            mode = s["mode"].cast("long")
            return (
                F.when(goal < 1, mode)
                .when(goal - 1 < w["up"], mode + F.greatest(reached(s, goal - 1, True), F.lit(1)))
                .otherwise(mode - F.least(F.greatest(reached(s, goal - 1 - w["up"], False), F.lit(1)), s["down"]))
            )

        return bound_to(F.struct(total_of(s, True).alias("up"), total_of(s, False).alias("down")), by_side)

    return bound_to(start, pick)


def split_counts(counts: Column, rows: Column, name: Column, seed: int) -> Column:
    """Of every entry of ``counts``, how many are among ``rows`` rows drawn from them all."""

    def one(at: Column, item: Column) -> Column:
        drawn = bound_to(
            hypergeometric(at["pool"], item["n"], at["need"], uniform(name, item["j"], seed)),
            lambda x: F.struct(
                (at["pool"] - item["n"]).alias("pool"), (at["need"] - x).alias("need"), F.concat(at["drawn"], F.array(x)).alias("drawn")
            ),
        )
        # nothing left to draw, or all that is left
        return F.when(item["n"] == 0, F.struct(at["pool"].alias("pool"), at["need"].alias("need"), F.concat(at["drawn"], F.array(F.lit(0).cast("long"))).alias("drawn"))).otherwise(drawn)

    pool = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)
    items = F.transform(counts, lambda n, j: F.struct(n.alias("n"), j.alias("j")))
    start = F.struct(pool.alias("pool"), rows.cast("long").alias("need"), F.expr("cast(array() as array<long>)").alias("drawn"))
    return F.aggregate(items, start, one, lambda at: at["drawn"])


def communication_matrix(chunks: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows that each chunk sends to each shard: (chunk, sent array<long>) for ``chunks`` (chunk long, n long).

    Row sums are the chunks' sizes, column sums the shards' sizes (equal but for one). A node of the tree has about
    64 children; the tree's depth grows with the logarithm of the chunks.
    """
    n_chunks, n_rows = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    groups = [max(1, math.ceil(n_chunks / FAN))]
    while groups[-1] > 1:
        groups.append(math.ceil(groups[-1] / FAN))
    # level 0 holds the chunks; each level's nodes hang below pmod(node, size of the next level)
    levels = [chunks.select(F.col("chunk").alias("node"), F.pmod(F.xxhash64("chunk", F.lit(seed)), F.lit(groups[0])).alias("above"), "n")]
    for size in groups[1:]:
        below = levels[-1].groupBy(F.col("above").alias("node")).agg(F.sum("n").alias("n"))
        levels.append(below.select("node", F.pmod("node", F.lit(size)).alias("above"), "n"))
    sizes = [n_rows // shards + (j < n_rows % shards) for j in range(shards)]
    counts = F.array(*[F.lit(s).cast("long") for s in sizes])
    tree = None

    def deal(at: Column, child: Column) -> Column:
        """Give one child its rows out of what is left of the counts."""
        drawn = split_counts(at["left"], child["n"], child["node"], seed)
        return bound_to(
            drawn,
            lambda d: F.struct(
                F.zip_with(at["left"], d, lambda a, b: a - b).alias("left"),
                F.concat(at["out"], F.array(F.struct(child["node"].alias("node"), d.alias("counts")))).alias("out"),
            ),
        )

    for level in reversed(levels):
        children = level.groupBy("above").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("children"))
        start = F.struct(F.col("counts").alias("left"), F.expr("cast(array() as array<struct<node: long, counts: array<long>>>)").alias("out"))
        # above the top level there is one node, the whole table
        children = children.withColumn("counts", counts) if tree is None else tree.join(children, "above")
        dealt = children.select(F.explode(F.aggregate("children", start, deal, lambda at: at["out"])).alias("x"))
        tree = dealt.select(F.col("x.node").alias("above"), F.col("x.counts").alias("counts"))
    return tree.select(F.col("above").alias("chunk"), F.col("counts").alias("sent"))


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 11, bits: int = 16) -> DataFrame:
    """Every row of ``docs`` in one of ``shards`` shards, uniformly at random, shards of equal size but for one row.

    The columns of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard); columns of these
    names are replaced. Values play no part: nulls, empty and long texts, ties and repeated rows are rows like any
    other, and an empty table gives an empty result. The draw hangs on ``seed`` and on the input's order of rows in
    its partitions; permuted rows are stored before anything is drawn, so a lost executor does not change it.
    """
    if shards < 1 or not 1 <= bits <= 30:
        raise ValueError("shards must be at least 1 and bits from 1 to 30")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at"))
    keyed = rows.select("row", "at", F.shiftright("at", bits).alias("chunk"), F.xxhash64("at", F.lit(seed)).alias("key"))
    # a partition's chunks are full but for the last, so a place in the sorted partition is a place in the chunk too
    local = keyed.sortWithinPartitions("chunk", "key", "at")
    local = local.select("row", "chunk", (F.monotonically_increasing_id() % (1 << bits)).alias("place"))
    stored = written(local)
    chunks = written(stored.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")))
    matrix = written(communication_matrix(chunks, shards, seed))
    total = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / shards / BLOCK_ROWS))

    running = F.aggregate(
        "sent", F.expr("cast(array() as array<long>)"), lambda ends, n: F.concat(ends, F.array(F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)) + n))
    )
    ends = matrix.select("chunk", running.alias("ends"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("place")))
    again = uniform("chunk", "place", seed + 1)
    sent = stored.join(ends, "chunk").select(
        "row", "chunk", "place", shard.alias("shard"), F.floor(again * blocks).cast("int").alias("block"), again.alias("key")
    )
    sizes = written(sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "block").orderBy("key", "chunk", "place")
    return sent.join(starts, ["shard", "block"]).select(
        *[F.col("row")[c].alias(c) for c in names], "shard", (F.col("start") + F.row_number().over(order) - 1).alias("slot")
    )


@query()
def op11_sharding(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = shuffle_into_shards(docs)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
