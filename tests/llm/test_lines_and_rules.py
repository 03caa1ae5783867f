import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import line_dedup, quality_rules

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))


def by_hand(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(BLANKS))
            if i is not None and len(key) >= 40:
                held[key].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stays = [not ((k := lower(s.strip(BLANKS))) in held and len(held[k]) >= 5 and i is not None and i != max(held[k])) for s in lines]
        out.append((i, "\n".join(s for s, x in zip(lines, stays) if x), len(lines), stays.count(False)))
    return sorted(out, key=str)


def test_lines(spark):
    rng = random.Random(1)
    pool = [f"{'É' if k % 2 else 'line'} number {k} " + "x" * 35 for k in range(12)] + ["short", "", " \t", "y" * 39, "y" * 40]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(rng.choice([s, s.upper() if s.isascii() else s, f" {s}\t\r"]) for s in lines)))
    rows += [(100, None), (101, ""), (None, pool[0]), (None, pool[1]), rows[3], (102, "\n" * 5), (103, (pool[0] + "\n") * 3000)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kept string, h1 int")
    got = line_dedup.drop_lines(docs)
    assert got.columns == ["doc_id", "text", "h1", "kept", "n_lines", "n_dropped"]
    assert sorted([(r["doc_id"], r["kept"], r["n_lines"], r["n_dropped"]) for r in got.collect()], key=str) == by_hand(rows)
    assert line_dedup.drop_lines(docs.limit(0)).count() == 0


def test_runs_keep_each_hash_fresh_once(spark):
    runs = line_dedup.Runs(spark, fan=2, buckets=2)
    rng, want, fresh = random.Random(2), defaultdict(lambda: [0, -1]), Counter()
    for b in range(5):
        batch = [(h, h + 1, rng.randint(1, 3), 10 * b + rng.randint(0, 9)) for h in rng.sample(range(30), 12)]
        for h, _, n, last in batch:
            want[h][0] += n
            want[h][1] = max(want[h][1], last)
        added = runs.add(spark.createDataFrame(batch, "h1 long, h2 long, docs long, last long"))
        fresh.update(r["h1"] for r in added.where("fresh").collect())
    assert {r["h1"]: [r["docs"], r["last"]] for r in runs.all().collect()} == dict(want)
    assert set(fresh) == set(want) and set(fresh.values()) == {1}
    # five runs: four have been compacted twice
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.drop()


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 5))
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), twice, len(cover)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghié", k=rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randint(20, 80))
        rows.append((i, " ".join(words), "en" if i % 3 else None, f"s{i % 2}"))
    rows += [(1000 + k, " ".join(w + "$$%" for w in rng.choices(vocabulary, k=40)), "en", "s0") for k in range(4)]
    rows += [(2000, None, "en", "s0"), (2001, "", None, None), (2002, "a b", "en", None), (2003, "one two three four five " * 30, "en", "s1")]
    rows += [(2004, "same line\n" * 40, "en", "s1"), rows[5], (None, rows[6][1], "en", "s1"), (2005, "x y z w v " + "longword" * 5000 + " tail of it is here", "en", "s1")]
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, lang string, source string, d2 double, g string")
    got = quality_rules.quality(docs).toPandas()
    have = sorted([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.itertuples()])
    assert have == sorted(statistics(t) for _, t, _, _ in rows)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in got.itertuples() if r.doc_id == r.doc_id}
    for i in (2000, 2001, 2002, 2003, 2004):
        assert verdict[i] == (True, False)
    # symbol noise is an outlier, plain texts are not
    assert not any(verdict[1000 + k][1] for k in range(4))
    assert all(verdict[i] == (False, True) for i in range(400))
    assert list(got.columns)[:4] == ["doc_id", "lang", "source", "g"]
    assert quality_rules.quality(docs.limit(0)).count() == 0


def test_each_statistic_decides_alone(spark):
    rng = random.Random(6)
    rows = corpus()[:400]
    vocabulary = rows[0][1].split() + rows[3][1].split() + rows[6][1].split()

    def words(n):
        return rng.choices(vocabulary, k=n)

    symbols = " ".join(w + "#" * (i % 2) for i, w in enumerate(words(60)))
    line = " ".join(words(3))
    lines = "\n".join([*[" ".join(words(20)) for _ in range(6)], *[line] * 4])
    rows += [(3000, symbols, "en", "s0"), (3001, lines, "en", "s0"), (3002, " ".join(w * 3 for w in words(40)), "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.quality(docs).collect()}
    assert [verdict[i] for i in (3000, 3001, 3002)] == [(False, False)] * 3
    assert all(verdict[i] == (False, True) for i in range(400))


def test_precision_is_the_inverse(spark):
    rng = np.random.default_rng(4)
    names = quality_rules.NAMES
    a = rng.normal(size=(4, 4))
    cov = a @ a.T + np.eye(4)
    row = {f"m_{n}": 0.0 for n in names} | {f"c_{p}_{q}": float(cov[i, j]) for i, p in enumerate(names) for j, q in enumerate(names) if j >= i}
    got = quality_rules.precision(spark.createDataFrame([row]).selectExpr("*", "'g' AS g"), "g").first()
    inverse = np.linalg.inv(cov)
    for i, p in enumerate(names):
        for j, q in enumerate(names):
            if j >= i:
                assert abs(got[f"p_{p}_{q}"] - inverse[i, j]) < 1e-9
