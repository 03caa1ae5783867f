"""Rows without time or key, series on one side only, and many distinct tokens."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import text as T
from tidemark.operators import evaluate as E
from tidemark.operators import segments as S
from tidemark.scan import Scan, with_blocks

KINDS = ("running_sum", "running_max", "max_before", "lag", "lead", "last_valid", "next_valid", "total", "maximum")


def test_scans_with_nulls_are_the_same_in_blocks(spark):
    rows = [(k, None if i % 11 == 0 else (i * 37) % 50, i, None if i % 4 == 0 else (i * 13) % 17) for i in range(60) for k in (1, None)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v int")

    def scanned(limit):
        scan = Scan(with_blocks(df, ["k"], "t", limit), ["k"], ["t", "i"])
        for kind in KINDS:
            getattr(scan, kind)(kind, "v")
        scan.row_number("n").history("before", "v", 3).future("after", "v", 3)
        return sorted(map(str, scan.columns().select("k", "t", "i", *KINDS, "n", "before", "after").collect()))

    assert scanned(4) == scanned(None)


def test_series_on_one_side(spark):
    schema = "s int, idx int, time double, mark string"
    target = spark.createDataFrame([(1, 0, 0.0, "a"), (1, 1, 2.0, "b"), (2, 0, 1.0, "a"), (2, 1, 4.0, "c")], schema)
    predicted = spark.createDataFrame([(1, 0, 0.5, "a"), (1, 1, 2.0, "b")], schema)
    got = {r.s: (r.distance, r.points, r.errors, r.rejected, r.span) for r in E.boundary_displacement(predicted, target, ["s"]).collect()}
    assert got == {1: (0.5, 2, 0, False, 2.0), 2: (0.0, 0, 2, False, 3.0)}


def test_short_series_stay_whole(spark):
    rows = [(s, f, 0.5, n) for s, n in ((1, 40), (2, 200)) for f in range(n // 2 + 1)]
    frames = spark.createDataFrame(rows, "s int, frame bigint, rms double, samples bigint")
    got = sorted((r.s, r.start, r.end) for r in S.windowed_cuts(frames, ["s"], 10, 2, 2.0, 6.0, limit_db=-22.0).collect())
    assert (1, 0, 40) in got
    long = [(a, b) for s, a, b in got if s == 2]
    assert long[0][0] == 0 and long[-1][1] == 200 and all(b == c for (_, b), (c, _) in zip(long, long[1:]))


def test_characters_for_many_tokens(spark):
    got = spark.range(100_000).select(A.code_point("id").alias("c"))
    assert got.distinct().count() == 100_000 and got.filter(F.length("c") != 1).count() == 0


def test_edit_distance_with_many_distinct_tokens(spark):
    n = 3000
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(n)).cast("array<string>").alias("a"), F.sequence(F.lit(5), F.lit(n + 5)).cast("array<string>").alias("b"))
    assert df.select(A.edit_distance("a", "b").alias("d")).first()["d"] == 10


def test_letters_of_each_language_stay(spark):
    df = spark.createDataFrame([("été* ñ", "fr"), ("été* x", "en"), ("straße §1", None)], "t string, l string")
    assert [r[0] for r in df.select(T.clean_by_language("t", "l")).collect()] == ["été ñ", "t x", "straße 1"]


def test_chain_checks_its_span(spark):
    from tidemark.chain import greedy_chain

    df = spark.createDataFrame([(1, float(i), float(i) + 50.0, 0.0) for i in range(100)], "s int, p double, r double, z double")
    blocked = with_blocks(df, ["s"], "p", 10)
    with pytest.raises(Exception, match="reaches further"):
        greedy_chain(blocked, ["s"], "p", "r", "z", span=5.0).count()
