import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align as A
from tidemark.operators import evaluate as E


def walk_back(x, y, costs):
    """The whole table, walked back cell by cell."""
    n, m = len(x), len(y)
    a, b = {"code": np.asarray(x)}, {"code": np.asarray(y)}
    left = costs.left(b)
    table = np.zeros((n + 1, m + 1), np.int64)
    table[:, 0], table[0, 1:] = np.arange(n + 1) * costs.up, np.cumsum(left)
    price = [costs.across(a, i, b) for i in range(n)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            table[i, j] = min(table[i - 1, j - 1] + price[i - 1][j - 1], table[i - 1, j] + costs.up, table[i, j - 1] + left[j - 1])
    cells, i, j = [(n, m)], n, m
    while i or j:
        steps = [(i - 1, j - 1)] if i and j and table[i, j] == table[i - 1, j - 1] + price[i - 1][j - 1] else []
        up = [(i - 1, j)] if i and table[i, j] == table[i - 1, j] + costs.up else []
        side = [(i, j - 1)] if j and table[i, j] == table[i, j - 1] + left[j - 1] else []
        i, j = (steps + (side + up if costs.left_first else up + side))[0]
        cells.append((i, j))
    return cells[::-1], int(table[n, m])


@pytest.mark.parametrize("costs", [A.EDITS, A.COMMON])
def test_path_in_parts_is_the_path_of_the_whole_table(costs):
    rng = random.Random(3)
    for _ in range(300):
        x, y = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(2)]
        want, cost = walk_back(x, y, costs)
        sides = {"code": np.asarray(x, np.int64)}, {"code": np.asarray(y, np.int64)}
        for most in (1, 20, 10**6):
            rows, columns = A.path(*sides, costs, most)
            assert list(zip(rows.tolist(), columns.tolist())) == want
        if x:
            assert A.block_edges(*sides, costs, *A.edges_of(*sides, costs))[0][-1] == cost


POINT = "s int, idx int, time double, mark string"


def series(rng, s, n):
    times = sorted(round(rng.uniform(0, n / 2), 2) for _ in range(n))
    return [(s, 3 * i, t, rng.choice("abcd")) for i, t in enumerate(times)]


def test_blocks_equal_one_call(spark):
    rng = random.Random(4)
    sizes = {0: (30, 41), 1: (50, 7), 2: (5, 6), 3: (33, 33), 4: (64, 16), 5: (1, 40), 6: (0, 30), 7: (25, 0), 8: (16, 16)}
    p, t = [], []
    for s, (n, m) in sizes.items():
        p, t = p + series(rng, s, n), t + series(rng, s, m)
    left, right = spark.createDataFrame(p, POINT), spark.createDataFrame(t, POINT)
    for compare in (lambda side: E.label_edits(left, right, ["s"], 0.4, 1.0, side), lambda side: E.boundary_displacement(left, right, ["s"], side)):
        whole, parts = ({r.s: r.asDict() for r in compare(side).collect()} for side in (1_000, 8))
        assert whole.keys() == parts.keys() == sizes.keys()
        for s, r in whole.items():
            assert parts[s] == pytest.approx(r), s


def test_steps_of_blocks(spark):
    rng = random.Random(5)
    words = {s: [[rng.choice("abc") for _ in range(rng.randint(20, 40))] for _ in range(2)] for s in range(6)}
    tables = [spark.createDataFrame([(s, i, x) for s, w in words.items() for i, x in enumerate(w[k])], "s int, i int, x string") for k in (0, 1)]

    def coded(a, b):
        left, right = A.codes(a["x"], b["x"])
        return {"code": left}, {"code": right}

    cut = [A.cut_series(df, ["s"], "i", ["x"], 7) for df in tables]
    run = A.BlockAlignment(*cut, ["s"], A.EDITS, coded)
    got = run.along(lambda a, b, i, j: [(int(x), int(y)) for x, y in zip(i, j)], "x bigint, y bigint")
    found = {(r["s"], 7 * r["_i"] + r["x"], 7 * r["_j"] + r["y"]) for r in got.collect()}
    want, costs = set(), {}
    for s, (a, b) in words.items():
        cells, costs[s] = walk_back([ord(c) for c in a], [ord(c) for c in b], A.EDITS)
        want |= {(s, *p) for p, q in zip(cells, cells[1:]) if (q[0] - p[0], q[1] - p[1]) == (1, 1)}
    assert found == want
    assert {r["s"]: r["cost"] for r in run.cost().collect()} == costs


def test_codes():
    a, b = A.codes(["x", None, "y"], ["y", "x", None, "z"])
    assert (a[0], a[2]) == (b[1], b[0]) and a[1] == b[2] and len({*a, *b}) == 4
    assert [len(c) for c in A.codes([], [])] == [0, 0]
