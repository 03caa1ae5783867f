import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import base, decontamination, ngram_join, substring_dedup, tables


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words_of(t):
    return (t or "").encode().split()


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def near_rows(seed, docs=90):
    rng = random.Random(seed)
    word = [f"w{k}" for k in range(300)]
    bases = [rng.choices(word, k=rng.randint(8, 120)) for _ in range(8)]
    passage = rng.choices(word, k=30)
    rows = []
    for i in range(docs):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(word)
        if i % 7 == 0:
            w = rng.choices(word, k=20) + passage
        if i % 5 == 0:
            w = [x.upper() for x in w[: rng.randint(len(w) // 2, len(w))]]
        rows.append((i, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE\ttwo"), (905, "one three"), (906, "long " * 4000), (907, "long " * 4000)]


@pytest.mark.parametrize("turned", [False, True])
def test_two_texts_of_one_id_lose_no_link(spark, turned):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(0, 40, 4):
        a, b = ([f"w{rng.randrange(500)}" for _ in range(40)] for _ in range(2))
        near = [*a[:39], "other"]
        two = [(k, " ".join(b)), (k, " ".join(a))]
        rows += [*(two[::-1] if turned else two), (k + 1, " ".join(near)), (k, " ".join(a))]
        want |= {k: k, k + 1: k}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("seed,large,often", [(1, 16, 1000), (2, 2, -1000)])
def test_classes(spark, seed, large, often, monkeypatch):
    monkeypatch.setattr(ngram_join, "OFTEN_LEAST", often)
    monkeypatch.setattr(ngram_join, "LARGE", large)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = near_rows(seed)
    sets = {}
    for i, t in rows:
        w = words_of(lower(t))
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = components(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(*r, 1, "s") for r in [*rows, rows[4], (None, rows[5][1])]], "doc_id long, text string, node int, gram string")
    got = sorted([tuple(r) for r in ngram_join.near_duplicates(docs).collect()], key=str)
    want = [(i, len(sets[i]), root[i]) for i, _ in [*rows, rows[4]]] + [(None, len(sets[5]), None)]
    assert got == sorted(want, key=str)


def test_products_of_near_copies(spark, monkeypatch):
    # copies of one text, each with up to eight words of its own: most pairs share n-grams, but too few
    rng, made, products = random.Random(8), [], ngram_join.products

    def counted(mixed):
        out = products(mixed)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "products", counted)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(200):
        w = list(base)
        for at in rng.sample(range(150), 1 + i % 8):
            w[at] = f"own{i}x{at}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(146)} for i, t in rows}
    root = components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(root.items()) and len(set(root.values())) > 1
    assert sum(made) <= 5 * len(rows)


def test_first_common_members_at_the_bounds(spark):
    # sizes from 75 to 100 and all places at which sets of the least overlap can differ: no link is lost
    rng, rows = random.Random(3), []
    for k, more in enumerate([0, 0, 1, 3, 7, 12, 18, 25, 33, 34]):
        for side in range(3):
            w = [f"a{k}s{side}w{x}" for x in range(104)]
            other = w[: len(w) - more] if side == 0 else w[more:] if side == 1 else w[more // 2 : len(w) - (more - more // 2)]
            if k:
                cut = max(0, (25 - more) // 10)
                for at in rng.sample(range(len(other)), cut):
                    other[at] = f"o{k}s{side}x{at}"
            i = 2 * len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    root = components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(root.items())


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0
    assert substring_dedup.drop_repeats(none).count() == 0
    assert decontamination.contamination(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def repeats_by_hand(texts, window):
    places = {}
    for d, t in enumerate(texts):
        w = words_of(t)
        for s in range(len(w) - window + 1):
            places.setdefault(tuple(w[s : s + window]), []).append((d, s))
    gone = [set() for _ in texts]
    for found in places.values():
        if len(found) > 1:
            for d, s in found:
                gone[d].update(range(s, s + window))
    return [(len(words_of(t)), len(g), b" ".join(w for p, w in enumerate(words_of(t)) if p not in g).decode()) for t, g in zip(texts, gone)]


@pytest.mark.parametrize("words", [2, 5, 400])
def test_repeats(spark, words):
    rng = random.Random(words)
    base = [f"b{x}" for x in rng.choices(range(words), k=300)]
    texts = []
    for _ in range(25):
        a, b = sorted(rng.sample(range(300), 2))
        own = [f"o{x}" for x in rng.choices(range(words if words < 400 else 5000), k=rng.randint(0, 60))]
        texts.append(" ".join(own + base[a:b]) + rng.choice(["", "\n", "\t x"]))
    texts += [None, "", "  ", "z " * 34, "z " * 36, "single", texts[3], "ab cd " * 5000]
    rows = [(i if i != 5 else None, t, 1, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor int, name string")
    got = substring_dedup.drop_repeats(docs).collect()
    want = [(i if i != 5 else None, *x) for i, x in enumerate(repeats_by_hand(texts, 35))]
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_leaks(spark):
    rng = random.Random(9)
    word = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    items = [(k, " ".join(rng.choices(word, k=n))) for k, n in enumerate([3, 9, 15, 22, 38, 59, 120])]
    rows, want = [], set()
    for i in range(60):
        w = rng.choices(word, k=rng.randint(30, 150))
        if i % 3 == 0:
            item, t = items[i % len(items)]
            part = t.upper().split() if i % 2 else t.split()
            at = rng.randrange(len(w))
            # a word lost at one end of long items
            w[at:at] = part[1:] if len(part) > 30 and i % 4 == 0 else part
            want.add((i, item))
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, items[4][1]), rows[0], (None, items[5][1]), (203, " ".join(rng.choices(word, k=20_000)) + " " + items[6][1])]
    want |= {(202, 4), (None, 5), (203, 6)}
    table = spark.createDataFrame([*items, (7, None), (8, ""), (None, "only a null id here to find")], "item_id long, text string")
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, item_id int, start string")
    got = decontamination.contamination(docs, table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    for r in got:
        text = dict((i, t) for i, t in rows)[r["doc_id"]]
        part = decontamination.words_of(text.encode())[r["start"] : r["start"] + r["words"]]
        item = decontamination.words_of(dict(items)[r["item_id"]].encode())
        assert r["similarity"] == decontamination.similarity(decontamination.weighed_shingles(part), decontamination.weighed_shingles(item)) >= 0.75
    kept = decontamination.without_benchmark(docs, table)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_words_are_not_remembered():
    # names of many different words took more CPU from a memory than from the hash
    names = base.WordIds()
    words = [b"w%d" % k for k in range(1000)]
    assert names.of(words).tolist() == [xxhash.xxh3_64_intdigest(w) for w in words] and not getattr(names, "__len__", int)()


def test_candidates_of_many_items():
    rng = np.random.default_rng(4)
    index = decontamination.Items([(k, b" ".join(b"%d" % x for x in rng.integers(0, 40, 6))) for k in range(400)])
    own = np.concatenate([index.prints[6], rng.integers(0, 2**63, 300, dtype=np.uint64)])
    at = np.arange(len(own)) * 7
    want = [(int(at[r]), int(i)) for k in range(0, len(index.prints[6]), 64) for r in range(len(own)) for i in range(k, min(k + 64, len(index.prints[6]))) if int(own[r] ^ index.prints[6][i]).bit_count() <= decontamination.RADIUS]
    assert index.candidates(own, 6, at) == want and len(want) >= 400


def test_cut_off_items():
    rng = random.Random(12)
    word = [f"{k}" + "".join(rng.choices("abcdefgh", k=4)) for k in range(2000)]
    items = [(k, " ".join(rng.choices(word, k=n)).encode()) for k, n in enumerate([9, 22, 38, 59, 120, 400])]
    index = decontamination.Items(items)
    other = " ".join(rng.choices(word, k=60)).encode()
    texts, want = [], []
    for item, text in items:
        words = text.split()
        n, whole = len(words), decontamination.weighed_shingles(words)
        for m in range(n * 3 // 4, n):
            for at in {0, (n - m) // 2, n - m}:
                part = words[at : at + m]
                held = {item} if decontamination.similarity(decontamination.weighed_shingles(part), whole) >= 0.75 else set()
                texts.append(b" ".join(part))
                want.append(held)
                # a start lost before other words, an end lost after them
                if held and at in (0, n - m):
                    texts.append(b" ".join([other, *part] if at == 0 else [*part, other]))
                    want.append(held)
    got = index.matches(texts)
    assert all(w <= set(g) for g, w in zip(got, want)) and sum(map(len, want)) > 100
    for g, t in zip(got, texts):
        for value, start, n in g.values():
            assert 0 <= start and start + n <= len(t.split()) and value >= 0.75


def test_steps_leave_no_files_of_exchanges(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f for f in held.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    def made(store):
        before = files()
        rows = store(spark.range(2000).selectExpr("id % 7 AS k").groupBy("k").count())
        return len(files() - before), rows.count()

    assert made(tables.written)[0] > 0 and made(tables.apart) == (0, 7)
