import random
import statistics

from pyspark.sql import functions as F

from tidemark.scan import BLOCK, Scan, exact_median, with_blocks


def _rows(seed):
    rng = random.Random(seed)
    rows = []
    for s, n in ((1, 60), (2, 3), (3, 1), (4, 25)):
        for i in range(n):
            rows.append((s, rng.randint(0, 500), i, rng.choice([None, rng.randint(-9, 9)])))
    return rows


def test_blocked_scan_equals_plain_window(spark):
    df = spark.createDataFrame(_rows(5), "s int, t bigint, id int, v int")

    def run(d):
        return (
            Scan(d, ["s"], ["t", "id"])
            .running_sum("rs", F.coalesce("v", F.lit(0)))
            .running_max("rm", "v")
            .max_before("mb", "v")
            .row_number("rn")
            .lag("lg", "v")
            .lead("ld", "v")
            .last_valid("lv", "v")
            .next_valid("nv", "v")
            .history("hs", "v", 3)
            .future("ft", "v", 3)
            .total("tt", "t")
            .maximum("mx", "t")
            .columns()
            .drop(BLOCK)
        )

    plain = sorted(map(tuple, run(df).collect()), key=str)
    blocked_input = with_blocks(df, ["s"], "t", rows_per_block=5)
    assert blocked_input.select(BLOCK).distinct().count() > 5
    assert sorted(map(tuple, run(blocked_input).collect()), key=str) == plain


def test_exact_median(spark):
    rng = random.Random(3)
    rows = [(k, round(rng.uniform(0, 50), 1)) for k in (1, 1, 1, 2, 3) for _ in range(rng.randint(1, 40))]
    counts = spark.createDataFrame(rows, "k int, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    got = {r.k: r.m for r in exact_median(counts, ["k"], "v", "n", "m", rows_per_block=4).collect()}
    want = {k: statistics.median([v for kk, v in rows if kk == k]) for k in {r[0] for r in rows}}
    assert got == want


def test_small_series_share_calls(spark):
    from tidemark.chain import map_series
    from tidemark.operators import segments as S

    # series around the size of a batch, NULL keys and keys that a float would not hold
    rows = [(None if k == 3 else (1 << 60) + k, i, float(i * k)) for k in range(40) for i in range(1 + 60 * (k % 7))]
    df = spark.createDataFrame(rows, "k bigint, i bigint, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = map_series(df, ["k"], "i", lambda pdf: pdf.tail(1).assign(n=len(pdf), total=pdf["v"].sum()), "k bigint, n bigint, total double")
        got = sorted((r.k is None, r.k, r.n, r.total) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, _, v in rows:
        n, total = want.get(k, (0, 0.0))
        want[k] = n + 1, total + v
    assert got == sorted((k is None, k, *x) for k, x in want.items())
    frames = df.filter("k is not null").select("k", F.col("i").alias("frame"), (F.col("v") + 1).alias("rms"), F.lit(400).alias("samples"))
    cut = S.windowed_cuts(frames, ["k"], 4, 1, 2.0, 6.0, limit_db=-22.0)
    assert "FlatMapGroups" not in cut._jdf.queryExecution().toString()
