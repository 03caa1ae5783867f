import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts

PATH = token_counts.vocabulary_path()
PARTS = [*" \n\t a bé's'll中文,.12  ", "<|endoftext|>", " the", "  ", "\n ", "'re", "　", "\r\n", "😀", "word.", "word", "\xa0", " ", " "]


def odd_texts(n, seed):
    rng = random.Random(seed)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "a ", " a", "a\n", "a \n", "\n a", "  ", "a" * 20_000, " " * 500, "héllo wörld. " * 300]


def test_heap_counts_equal_the_library():
    library, counts = Tokenizer.from_file(PATH), token_counts.merger(PATH)
    texts = odd_texts(3000, 1)
    assert [counts.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = odd_texts(3000, 2)
    assert own.ids(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_count_rows(spark):
    rows = [(1, "a b", 5), (1, "a b", 6), (2, None, 7), (None, "", 8), (3, "x" * 3000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(token_counts.count_tokens(docs, PATH).collect(), key=str)
    library = Tokenizer.from_file(PATH)
    n = len(library.encode("x" * 3000, add_special_tokens=False).ids)
    want = [(1, 3, 2, False), (1, 3, 2, False), (2, 0, 0, False), (3, 3000, n, n > 512), (None, 0, 0, False)]
    assert [tuple(r) for r in got] == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 300) if seed % 2 else rng.integers(22, 40, 300)
    bins = packing.best_fit(lengths, 64)
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= 64 and (fill > 0).all()
    bound = packing.lower_bound(lengths, 64)
    assert -(-lengths.sum() // 64) <= bound <= len(fill)


def test_bound_sees_what_cannot_share_a_bin():
    # three of 33 need three bins of 64 though their sum needs two
    assert packing.lower_bound(np.asarray([33, 33, 33]), 64) == 3
    # thirds that are a little too large
    assert packing.lower_bound(np.asarray([22] * 6), 64) == 3


def test_packed_documents(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["one", "two", "three,", "vier"], k=rng.randint(0, 90))) for _ in range(150)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "y"), (None, "lost", "z"), (500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packing.pack_documents(docs, PATH, 32).toPandas()
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t, _ in rows:
        ids = np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 32 or 32
        cuts = [0, *range(first, len(ids) + 1, 32)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    have = [(None if d != d else int(d), *map(int, r)) for d, *r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 32
    assert got["sequence_id"].nunique() == packing.lower_bound(got["length"].to_numpy(), 32)
    assert packing.pack_documents(docs.limit(0), PATH, 32).count() == 0


def test_exchange_of_loose_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(x)) for i, x in enumerate(rng.integers(1, 65, 2000))]
    items = spark.createDataFrame(rows, "id long, length long")
    got = packing.pack(items, 64, rows_per_part=100).toPandas()
    assert sorted(got["id"]) == [i for i, _ in rows]
    fill = got.groupby(["round", "part", "bin"])["length"].sum()
    assert fill.max() <= 64
    alone = packing.pack(items, 64, rows_per_part=100, rounds=0).toPandas()
    assert len(fill) <= alone.groupby(["round", "part", "bin"]).ngroups
    assert packing.pack(items, 64, rows_per_part=100, rounds=0).count() == 2000
