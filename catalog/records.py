"""Queries over layouts of records and over scripts that the given texts are turned into."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import HOUR, query, table
from catalog.events import INDEXED, indexed
from tidemark.functions import text as T
from tidemark.sinks import tables as K

# letters of the given texts as kana
LETTERS_OF_TEXT = "abcdefghijklmnopqrstuvwxyz"
KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハ"
KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
HIRAGANA = "".join(chr(c) for c in range(0x3041, 0x3097))
TIMES = "(us / {0} - 473400)".format(HOUR)


@query(f"""WITH {INDEXED}, p AS (SELECT user_id, idx // 4 AS w, idx, {TIMES} AS a, {TIMES} + value / 100 AS b, event_type AS t FROM ix)
SELECT user_id, 'words' AS tier, round(min(a), 6) AS "start", round(max(b), 6) AS "end", string_agg(t, ' ' ORDER BY idx) AS text FROM p GROUP BY user_id, w
UNION ALL SELECT user_id, 'phones', round(greatest(0, a), 6), round(b, 6), t FROM p""")
def tier_layout(spark, folder):
    """Four events of a user are a word, each event is a part; the timeline starts in the middle."""
    start = F.col("us") / HOUR - 473_400
    parts = indexed(spark, folder).select(
        "user_id", F.floor(F.col("idx") / 4).alias("w"), "idx", F.struct(start.alias("start"), (start + F.col("value") / 100).alias("end"), F.col("event_type").alias("text")).alias("part")
    )
    words = parts.groupBy("user_id", "w").agg(
        F.min("part.start").alias("start"), F.max("part.end").alias("end"), F.array_sort(F.collect_list(F.struct("idx", "part"))).alias("_p")
    )
    words = words.select("user_id", "start", "end", F.col("_p.part").alias("parts")).withColumn("text", F.array_join(F.col("parts.text"), " "))
    out = K.tier_rows(words, ["user_id"])
    return out.select("user_id", "tier", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text")


@query("""SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:6], ' ') AS raw_text, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) AS lab, lower(array_to_string(string_split(text, ' ')[1:6], ' ')) AS lab_without_tone FROM conversations""")
def match_records(spark, folder):
    words = F.slice(F.split("text", " "), 1, 6)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", words.alias("matched_text"), F.transform(words, F.lower).alias("matched"))
    return K.match_documents(turns, ["conv_id", "turn"])


@query(f"""WITH k AS (SELECT doc_id, translate(lower(text), '{LETTERS_OF_TEXT}', '{KANA}') AS kana FROM documents)
SELECT doc_id, md5(translate(kana, '{KATAKANA}', '{HIRAGANA}')) AS hiragana, md5(translate(translate(kana, '{KATAKANA}', '{HIRAGANA}'), '{HIRAGANA}', '{KATAKANA}')) AS katakana,
  CAST(len(regexp_extract_all(kana, '(?s)[ァ-ヶ][ャュョァィゥェォ]?ー?|.')) AS INTEGER) AS morae FROM k""")
def kana_scripts(spark, folder):
    """Every text spelt in kana: both scripts and its number of morae."""
    kana = F.translate(F.lower("text"), LETTERS_OF_TEXT, KANA)
    docs = table(spark, folder, "documents").select("doc_id", kana.alias("kana"))
    return docs.select(
        "doc_id", F.md5(T.to_hiragana("kana").cast("binary")).alias("hiragana"), F.md5(T.to_katakana(T.to_hiragana("kana")).cast("binary")).alias("katakana"),
        F.size(T.kana_tokens("kana")).alias("morae"),
    )


#: ASCII words and marks go, and Han characters are joined across blanks; twice, as a match takes both neighbours.
@query(r"""WITH h AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'ja' ELSE 'en' END AS lang, translate(text, 'aeiou', '阿俄衣欧乌') AS t FROM documents),
  b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(trim(t, ' '), '[A-Za-z]+(?:[''’\-][A-Za-z]+)*', ' ', 'g'), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]+', ' ', 'g'), '[\s\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ') AS bare FROM h)
SELECT doc_id, md5(CASE WHEN lang = 'en' THEN trim(t, ' ') ELSE regexp_replace(regexp_replace(bare, '([㐀-鿿])\s+([㐀-鿿])', '\1\2', 'g'), '([㐀-鿿])\s+([㐀-鿿])', '\1\2', 'g') END) AS filtered FROM b""")
def script_filtered(spark, folder):
    """Texts with vowels as Han characters, by the rules of three languages in turn."""
    language = F.element_at(F.array(F.lit("zh"), F.lit("ja"), F.lit("en")), (F.col("doc_id") % 3 + 1).cast("int"))
    docs = table(spark, folder, "documents").select("doc_id", language.alias("language"), F.translate("text", "aeiou", "阿俄衣欧乌").alias("t"))
    return docs.select("doc_id", F.md5(T.script_filter("t", F.col("language")).cast("binary")).alias("filtered"))
