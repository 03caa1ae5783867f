from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import lookup as L


def test_dictionary(spark):
    docs = spark.createDataFrame([(1, "la di zz la"), (2, "qq")], "d int, t string").withColumn("k", F.split("t", " "))
    dic = spark.createDataFrame([("la", ["l", "a"]), ("di", ["SP", "d", "SP", "i", "SP"])], "key string, values array<string>")
    known, unknown = L.dictionary_join(L.explode_tokens(docs, ["d"], "k"), dic, ["d"])
    assert sorted((r.token, r.n) for r in unknown.collect()) == [("qq", 1), ("zz", 1)]
    r = L.dictionary_words(known, ["d"], "en").collect()
    assert [(x.d, x.words) for x in r] == [(1, ["la", "di", "la"])]
    assert r[0].labels == ["SP", "en/l", "en/a", "SP", "en/d", "SP", "en/i", "SP", "en/l", "en/a", "SP"]
    assert r[0].word_index == [-1, 0, 0, -1, 1, 1, 1, -1, 2, 2, -1]


def test_readings(spark):
    texts = spark.createDataFrame([(1, "银行长大行"), (2, "行")], "d int, t string").withColumn("k", T.mixed_tokens("t"))
    words = spark.createDataFrame([("银", ["yín"]), ("行", ["xíng"]), ("长", ["cháng"]), ("大", ["dà"])], "key string, values array<string>")
    phrases = spark.createDataFrame([("银行", ["yín", "háng"]), ("长大", ["zhǎng", "dà"])], "key string, values array<string>")
    many = spark.createDataFrame([("行",), ("长",)], "key string")
    got = L.readings(L.explode_tokens(texts, ["d"], "k"), ["d"], words, phrases, many)
    plain = got.select("d", F.transform("readings", T.fold_tones).alias("r")).collect()
    assert {r.d: r.r for r in plain} == {1: ["yin", "hang", "zhang", "da", "xing"], 2: ["xing"]}


def test_overlay(spark):
    rows = [("a", "x", "1", 0), ("a", "y", "2", 0), ("b", None, "p", 0), ("a", "x", "9", 2), ("a", "z", "3", 1), ("b", "q", "no", 1), ("c", "x", "no", 1), ("a", None, "no", 1), ("b", None, "r", 1)]
    got = L.layered_overlay(spark.createDataFrame(rows, "section string, key string, value string, layer int")).collect()
    assert sorted((r.section, r.key or "", r.value) for r in got) == [("a", "x", "9"), ("a", "y", "2"), ("a", "z", "3"), ("b", "", "r")]


def test_ranked(spark):
    df = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(40 if k == 1 else 5)], "k int, i int")
    last = L.last_per_key(df, ["k"], ["i"], 7).groupBy("k").agg(F.min("i").alias("m"), F.count("*").alias("n")).collect()
    assert {r.k: (r.m, r.n) for r in last} == {1: (33, 7), 2: (0, 5)}
    for block in (6, 10**6):
        top = L.top_share(df, ["k"], ["i"], 0.5, 3, block).groupBy("k").count().collect()
        assert {r.k: r["count"] for r in top} == {1: 20, 2: 3}


def test_manifest(spark):
    kind = "md5 string, output_key string, seq bigint"
    old = spark.createDataFrame([("a", "ka", 1), ("b", "kb", 1)], kind)
    new = spark.createDataFrame([("a", "ka2", 2), ("c", "kc", 1)], kind)
    both = L.upsert_latest(old, new)
    assert sorted(tuple(r) for r in both.collect()) == [("a", "ka2", 2), ("b", "kb", 1), ("c", "kc", 1)]
    outputs = spark.createDataFrame([("ka2",), ("kc",)], "output_key string")
    inputs = spark.createDataFrame([("a",), ("b",), ("d",)], "md5 string")
    assert sorted(r.md5 for r in L.new_inputs(inputs, both, outputs).collect()) == ["b", "d"]
    r = L.missing_report(inputs, outputs.withColumnRenamed("output_key", "md5"), "md5", 2).collect()[0]
    assert (r.missing, r.preview) == (3, ["a", "b"])
    done = L.complete_from(inputs.filter("md5 = 'a'").withColumn("v", F.lit(1)), inputs, ["md5"])
    assert sorted((r.md5, r.v) for r in done.collect()) == [("a", 1), ("b", None), ("d", None)]
    pairs, missing = L.keyed_join(spark.createDataFrame([("s_1_02",), ("t_01",)], "name string"), spark.createDataFrame([("s_1",)], "song string"), "name", "song")
    assert [r.name for r in pairs.collect()] == ["s_1_02"] and [r.song for r in missing.collect()] == ["t"]
