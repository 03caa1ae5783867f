import hashlib
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.sinks import tables as K
from tidemark.sources import files as S
from tidemark.sources import tables as B


@pytest.fixture(scope="module")
def folder():
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    os.makedirs(f"{path}/in/sub")
    for name, data in {"in/a b.WAV": b"xx", "in/sub/c.wav": b"yy", "in/d.txt": b"no", "in/a b.lab": b"la di"}.items():
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    return path


def test_listing(spark, folder):
    every = S.list_files(spark, f"{folder}/in").select("stem", "extension", S.content_key("stem", "content").alias("k"))
    got = {r.stem: (r.extension, r.k.output_key) for r in every.collect()}
    assert got["c"][0] == ".wav" and set(got) == {"a b", "c"}
    assert got["a b"][1] == "a_b_" + hashlib.md5(b"xx").hexdigest()[:8]
    labels = S.read_documents(spark, f"{folder}/in/*.lab")
    pairs, missing = S.pair_files(S.list_files(spark, f"{folder}/in"), labels)
    assert [(r.stem, r.label_text) for r in pairs.collect()] == [("a b", "la di")]
    assert [r.stem for r in missing.collect()] == ["c"]


def test_dictionaries(spark, folder):
    with open(f"{folder}/dict.txt", "w") as f:
        f.write("a:x,y\n\nb:z\na:q:r,s\n")
    got = {r.key: r["values"] for r in B.read_dictionary(spark, f"{folder}/dict.txt").collect()}
    assert got == {"a": ["q:r", "s"], "b": ["z"]}
    v = spark.range(1).select(B.vocabulary(F.lit('{"a": 1, "PAD": 5}')).alias("v")).collect()[0].v
    assert v.tokens == {1: "a", 5: "PAD"} and v.blank == 5


def test_documents(spark):
    records = {"m1": {"output_key": "k", "source_name": "n", "source_path": "p", "chunks": 2, "labs": 1}, "m2": 3}
    rows = spark.createDataFrame([(json.dumps({"m1": records["m1"]}),), ("[1]",), ("{broken",)], "value string")
    assert [(r.md5, r.output_key, r.chunks) for r in B.parse_manifest(rows).collect()] == [("m1", "k", 2)]
    chunk = {"index": 0, "offset": 1.5, "duration": 2.0, "text": "x"}
    docs = spark.createDataFrame([(1, json.dumps({"source": {"path": "p", "md5": "m"}, "chunks": [chunk]})), (2, json.dumps([chunk, chunk]))], "d int, value string")
    got = [(r.d, r.offset) for r in B.timing_rows(docs).collect()]
    assert sorted(got) == [(1, 1.5), (2, 1.5), (2, 1.5)]
    texts = spark.createDataFrame([('{"text":"a"}',), ('{"text":"","transcript":"b"}',), ("c",), (None,), ('{"z":1}',)], "t string")
    assert [r.x for r in texts.select(B.result_text("t").alias("x")).collect()] == ["a", "b", "c", "", ""]


def test_note_files(spark, folder):
    rows = [(1, 0, 0.0, 0.5, 60.25, "la"), (1, 1, 0.5, 1.0, 61.75, ""), (1, 2, 1.0, 1.0, 60.0, "x"), (2, 0, 0.0, 0.3333, 60.1234, "")]
    notes = spark.createDataFrame(rows, "s int, idx int, onset double, offset double, pitch double, lyric string")
    named = K.note_rows(notes, ["s"], "name")
    assert sorted((r.s, r.onset, r.offset, r.pitch, r.lyric) for r in named.collect()) == [
        (1, "0.000", "0.500", "C4+25", "la"), (1, "0.500", "1.000", "D4-25", ""), (2, "0.000", "0.333", "C4+12", "")
    ]
    assert {r.s: r.skipped for r in K.skipped_notes(notes, ["s"]).collect()} == {1: 1, 2: 0}
    K.write_notes(K.note_rows(notes, ["s"]), ["s"], f"{folder}/csv")
    back = spark.read.option("header", "true").csv(f"{folder}/csv/lyrics=true/s=1")
    assert [tuple(r) for r in back.collect()][0] == ("0.000", "0.500", "60.250", "la")
    K.write_notes(K.note_rows(notes, ["s"]), ["s"], f"{folder}/txt", "txt")
    assert [r.value for r in spark.read.text(f"{folder}/txt/lyrics=false/s=2").collect()] == ["0.000\t0.333\t60.123"]
    doc = K.project_documents(notes, ["s"], 120.0).filter("s = 1").collect()[0]
    assert doc.duration == 960 and [(n.position, n.duration, n.tone, n.lyric) for n in doc.notes] == [(0, 480, 60, "la"), (480, 480, 62, "a")]


def test_label_files(spark, folder):
    kind = "s int, start double, end double, text string, parts array<struct<start:double,end:double,text:string>>"
    words = spark.createDataFrame([(1, 0.0, 0.29, "a", [(-0.1, 0.29, "x")]), (2, 0.5, 1.0, "b", [])], kind)
    lines = K.label_lines(words, ["s"], "start", "end", "text")
    K.write_labels(lines, ["s"], "start", f"{folder}/lab")
    assert [r.value for r in spark.read.text(f"{folder}/lab/s=1").collect()] == [f"0 {int(0.29 * 1e7)} a"]
    assert sorted((r.s, r.tier, r.start, r.text) for r in K.tier_rows(words, ["s"]).collect()) == [(1, "phones", 0.0, "x"), (1, "words", 0.0, "a"), (2, "words", 0.5, "b")]
    chunks = spark.createDataFrame([(1, 1, 2.0000004, 1.0, " b "), (1, 0, 0.5, 1.0, "a")], "s int, index int, offset double, duration double, text string").withColumn("p", F.lit("p")).withColumn("m", F.lit("m"))
    d = K.timing_documents(chunks, ["s"], "p", "m").collect()[0]
    assert [(c["index"], c.offset, c.text) for c in d.chunks] == [(0, 0.5, "a"), (1, 2.0, "b")]
    key = spark.range(1).select(K.segment_key(F.lit("s"), F.lit(3), F.lit(12.5), F.lit(3.2)).alias("k")).collect()[0].k
    assert key == "s_chunk0003_off00012.50s_dur0003.20s"
    m = spark.createDataFrame([(1, "raw", ["a"], ["A"], 0, 1, "", "matched", "A"), (2, "r2", [], [], -1, -1, "none", "no_match", "")], "s int, raw string, matched array<string>, matched_text array<string>, start int, end int, reason string, status string, final string")
    assert [(r.raw_text, r.lab) for r in K.match_documents(m, ["s"]).collect()] == [("A", "a"), ("", "")]
    log = K.decision_log(m, ["s"], "raw", "status", "final").collect()
    assert log[0].log == "[1]\nASR Output: raw\nMatch Status: matched\nMatched Lyric Segment: A\nMatched Lyric Phonetic: a\nFinal Assigned Lyrics: A"
    assert "Match Reason: none" in log[1].log
