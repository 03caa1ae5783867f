import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


@pytest.mark.parametrize("n, k, m", [(10, 3, 4), (10, 10, 4), (10, 0, 4), (1, 1, 1), (50, 25, 25), (1000, 62, 500), (40, 39, 38)])
def test_hypergeometric_law(spark, n, k, m):
    law = {x: math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(max(0, m + k - n), min(m, k) + 1)}
    draws = 20_000
    drawn = spark.range(draws).select(sharding.hypergeometric(F.lit(n), F.lit(k), F.lit(m), sharding.uniform("id", 3)).alias("x"))
    seen = dict(drawn.groupBy("x").count().collect())
    assert set(seen) <= set(law)
    often = {x: draws * p for x, p in law.items() if draws * p >= 5}
    chi = sum((seen.get(x, 0) - e) ** 2 / e for x, e in often.items())
    assert chi < len(often) + 5 * math.sqrt(2 * len(often))


def test_matrix_sums_and_spread(spark):
    sizes = [8] * 600 + [3, 1]
    chunks = spark.createDataFrame([(i << 17, n) for i, n in enumerate(sizes)], "chunk long, n long")
    rows = sharding.communication_matrix(chunks, 5, 1).collect()
    sent = {r["chunk"] >> 17: r["sent"] for r in rows}
    assert {i: sum(s) for i, s in sent.items()} == dict(enumerate(sizes))
    total = sum(sizes)
    assert [sum(s[j] for s in sent.values()) for j in range(5)] == [total // 5 + (j < total % 5) for j in range(5)]
    # counts of eight rows spread over a fifth of the table follow the law, not the mean
    seen = Counter(sent[i][2] for i in range(600))
    law = {x: 600 * math.comb(8, x) * 0.2**x * 0.8 ** (8 - x) for x in range(5)}
    assert sum((seen[x] - e) ** 2 / e for x, e in law.items()) < 25


@pytest.mark.parametrize("bits", [3, 16])
def test_shards(spark, bits):
    rows = [(i if i % 7 else None, "x" * (i % 50) if i % 3 else None, i, "k", i % 4, -i) for i in range(2_003)]
    rows += [rows[5]] * 1_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int, chunk string, shard int, row int").repartition(3)
    got = sharding.shuffle_into_shards(docs, 4, seed=2, bits=bits)
    assert got.columns == ["doc_id", "text", "at", "chunk", "row", "shard", "slot"]
    placed = got.collect()
    assert Counter((r["doc_id"], r["text"], r["at"], r["row"]) for r in placed) == Counter((r[0], r[1], r[2], r[5]) for r in rows)
    slots = defaultdict(list)
    for r in placed:
        slots[r["shard"]].append(r["slot"])
    assert sorted(len(s) for s in slots.values()) == [750, 751, 751, 751]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # rows that stood together are dealt evenly, and their order is gone
    early = [r for r in placed if r["at"] < 1_000 and r["at"] != 5]
    assert all(190 < n < 310 for n in Counter(r["shard"] for r in early).values())
    n = len(early)
    mean_at, mean_slot = (n - 1) / 2, sum(r["slot"] for r in early) / n
    covariance = sum((r["at"] - mean_at) * (r["slot"] - mean_slot) for r in early)
    spread = math.sqrt(sum((r["at"] - mean_at) ** 2 for r in early) * sum((r["slot"] - mean_slot) ** 2 for r in early))
    assert abs(covariance / spread) < 5 / math.sqrt(n)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["slot"]) for r in sharding.shuffle_into_shards(docs).collect()) == [(1, 0), (2, 0)]
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(docs, 0)
