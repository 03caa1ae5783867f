import random
import zlib

import numpy as np

from tidemark.llm import language_id, toxicity


def kept_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def by_hand(index, text, k):
    """Cosines with every example."""
    t, w = index._weigh(*toxicity.terms(text))
    score = np.zeros(index.n)
    for x, q in zip(t, w):
        lo, hi = index.start[x], index.start[x + 1]
        score[index.at[lo:hi]] += q * index.weight[lo:hi]
    order = np.lexsort((np.arange(index.n), -np.round(score, 12)))
    return [(int(i), round(float(score[i]), 9)) for i in order[:k] if score[i] > 0]


def toxic_rows(seed=1):
    rng = random.Random(seed)
    plain, bad = [f"plain{k}" for k in range(200)], ["awful", "nasty", "vileness", "hateful"]
    rows, labels = [], []
    for i in range(700):
        w = rng.choices(plain, k=rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            w += rng.sample(bad, 2)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    more = [(9001, None), (9002, ""), (9003, "awful " * 5000), (None, "a nasty hateful thing"), rows[3]]
    docs = spark.createDataFrame([(*r, 3.0, 1) for r in rows + more], "doc_id long, text string, score double, toxic int")
    table = spark.createDataFrame([*labels, (1, None), (None, 1), (88888, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, table)
    got = toxicity.score(docs, index).collect()
    assert len(got) == len(rows) + len(more)
    held = [(r["doc_id"] % 5 == 0, r["predicted"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 9000 and kept_out(r["doc_id"])]
    assert sum(a == bool(b) for a, b in held) / len(held) > 0.98
    score = {r["doc_id"]: r["score"] for r in got}
    assert score[9001] == score[9002] == 0.0 and score[9003] > 0.3 and score[None] > 0.3
    assert all(0 <= r["score"] <= 1 for r in got)
    # the nearest are exact, however few blocks are opened
    opened = 0
    for _, text in rows[:200]:
        i, s, n = index.nearest(*toxicity.terms(text), 5)
        assert [(int(a), round(float(b), 9)) for a, b in zip(i, s)] == by_hand(index, text, 5)
        opened += n
    assert toxicity.score(docs.limit(0), index).count() == 0
    empty = toxicity.fit(docs, table.limit(0))
    assert {r["score"] for r in toxicity.score(docs, empty).collect()} == {0.0}


def test_blocks_stay_closed(monkeypatch):
    monkeypatch.setattr(toxicity, "OPENED", 1)
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(0, 2**63, 300, dtype=np.uint64))
    vectors = []
    for k in range(2000):
        part = np.sort(rng.choice(names[(k % 30) * 10 : (k % 30) * 10 + 10], 4, replace=False))
        vectors.append((part, np.ones(4, np.int64)))
    index = toxicity.Index(names, np.ones(300), vectors, np.arange(2000) % 2, 0.5)
    _, s, opened = index.nearest(names[20:24], np.ones(4, np.int64), 5)
    assert len(s) == 5 and 0 < opened < index.blocks


def language_rows(seed=3):
    rng = random.Random(seed)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ver", "lich"], "cc": ["ción", "ado", "ñe", "ll"]}
    rows = []
    for i in range(600):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choices(sounds[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_languages(spark):
    rows = language_rows()
    more = [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 34 -- !", "cc"), (None, rows[0][1], None), rows[4], (9004, rows[1][1] * 2000, None), (9005, "日本語の文章です", None)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows + more], "doc_id long, text string, lang string, score double, nearest string")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    held = [(r["lang"], r["nearest"]) for r in got if r["doc_id"] is not None and r["doc_id"] < 9000 and kept_out(r["doc_id"])]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    by_id = {r["doc_id"]: r for r in got}
    for i in (9001, 9002, 9003):
        assert (by_id[i]["lang_pred"], by_id[i]["nearest"], by_id[i]["score"]) == ("und", "und", 0.0)
    assert by_id[None]["nearest"] == "aa" and by_id[9004]["nearest"] == "bb"
    # far from every centroid: rejected, with a nearest language all the same
    assert by_id[9005]["lang_pred"] == "und" and by_id[9005]["nearest"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(docs.limit(0), model).count() == 0
    none = language_id.identify(docs, language_id.fit(docs.limit(0))).collect()
    assert {r["nearest"] for r in none} == {"und"}
