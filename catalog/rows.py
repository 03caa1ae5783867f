"""Queries of validation, selection, lookup and file layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import EVENTS, HOUR, NOTES, days, events, notes, query, table
from catalog.events import SEGMENT_COLUMNS, _segments, segmented
from tidemark.functions import arrays as A
from tidemark.functions import checks as C
from tidemark.functions import grid as G
from tidemark.functions import text as T
from tidemark.operators import evaluate as E
from tidemark.operators import islands as I
from tidemark.operators import lookup as L
from tidemark.sinks import tables as K
from tidemark.sources import tables as B

U = ["user_id"]


@query(f"""WITH {NOTES} SELECT user_id, count(*) FILTER (CASE WHEN pitch > 80 THEN FALSE ELSE "offset" > onset + 0.1 END) AS valid, count(*) FILTER (NOT CASE WHEN pitch > 80 THEN FALSE ELSE "offset" > onset + 0.1 END) AS skipped FROM nt GROUP BY 1""")
def finite_filter(spark, folder):
    n = notes(spark, folder).withColumn("pitch", F.when(F.col("pitch") > 80, float("nan")).otherwise(F.col("pitch")))
    fine = C.finite_interval(F.col("onset") + 0.1, "offset", "pitch")
    return n.groupBy("user_id").agg(F.count_if(fine).alias("valid"), F.count_if(~fine).alias("skipped"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN NOT (l_quantity * 2 - 20) BETWEEN 0 AND 60 THEN 'slice_min_sec must be within 0-60 seconds' WHEN NOT (l_quantity + l_tax * 300) BETWEEN 0 AND 60 THEN 'slice_max_sec must be within 0-60 seconds'
  WHEN l_quantity + l_tax * 300 <= 0 THEN 'slice_max_sec must be greater than 0 seconds' WHEN l_quantity * 2 - 20 > l_quantity + l_tax * 300 THEN 'slice_min_sec must be less than or equal to slice_max_sec' END AS problem FROM lineitem""")
def bounds_check(spark, folder):
    low, high = F.col("l_quantity") * 2 - 20, F.col("l_quantity") + F.col("l_tax") * 300
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", C.bounds_error(low, high).alias("problem"))


def order_arrays(spark, folder):
    """Line items of an order as parallel arrays; two lines form a word."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))
    packed = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("x"))
    n = F.size("x")
    return packed.select(
        "l_orderkey", F.transform("x", lambda v: v["f"]).alias("labels"), F.transform("x", lambda v: v["q"]).alias("durations"),
        F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")), lambda i: F.least(F.lit(2), n - i * 2)).alias("spans"),
    )


LINES = """li AS (SELECT l_orderkey, l_returnflag AS f, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) - 1 AS p FROM lineitem)"""


@query(f"""WITH {LINES}, w AS (SELECT l_orderkey, p // 2 AS word, sum(q) AS duration, CASE WHEN bool_and(f IN ('N', 'R')) THEN 0 ELSE 1 END AS voiced FROM li GROUP BY 1, 2)
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS words, sum(duration) AS total, CAST(count(*) FILTER (voiced = 0) AS INTEGER) AS unvoiced FROM w GROUP BY 1""")
def group_durations(spark, folder):
    out = E.group_durations(order_arrays(spark, folder), "labels", "durations", "spans", ["N", "R"])
    return out.select(
        "l_orderkey", F.size("words").alias("words"), A.array_total(F.transform("words", lambda w: w["duration"])).alias("total"),
        F.size(F.filter("words", lambda w: w["voiced"] == 0)).alias("unvoiced"),
    )


@query(f"""WITH {LINES} SELECT l_orderkey, CASE WHEN count(*) % 2 = 1 THEN 'Word span mismatch' ELSE 'fits' END AS outcome FROM li GROUP BY 1""")
def shape_check(spark, folder):
    two = order_arrays(spark, folder).withColumn("spans", F.transform("spans", lambda s: F.lit(2)))
    problem = C.shape_error("labels", "durations", "spans")
    return two.select("l_orderkey", F.coalesce(F.substring_index(problem, ":", 1), F.lit("fits")).alias("outcome"))


@query(f"""WITH {LINES} SELECT l_orderkey, f AS label, q AS duration FROM li WHERE q > 25""")
def compact_arrays(spark, folder):
    mask = F.transform("durations", lambda d: d > 25)
    kept = A.compact(mask, label=F.col("labels"), duration=F.col("durations"))
    return order_arrays(spark, folder).select("l_orderkey", F.inline(kept))


@query(f"""WITH {LINES}, a AS (SELECT l_orderkey, list(f ORDER BY p) AS l FROM li GROUP BY 1), n AS (SELECT l_orderkey, l, lead(l) OVER (ORDER BY l_orderkey) AS m FROM a)
SELECT l_orderkey, CAST(len(list_distinct(l)) AS INTEGER) AS kinds, len(list_filter(list_distinct(l), lambda x: x NOT IN ('A', 'N'))) = 0 AS within, list_has_any(l, ['R']) AS has_r,
  CAST(len(list_filter(generate_series(1, least(len(l), 3)), lambda i: l[i] <> (['A', 'N', 'R'])[i])) + abs(len(l) - 3) AS INTEGER) AS differences FROM a""")
def set_and_position_tests(spark, folder):
    a = order_arrays(spark, folder)
    anr = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return a.select(
        "l_orderkey", F.size(F.array_distinct("labels")).alias("kinds"), A.is_subset("labels", F.array(F.lit("A"), F.lit("N"))).alias("within"),
        F.arrays_overlap("labels", F.array(F.lit("R"))).alias("has_r"), A.difference_count("labels", anr).alias("differences"),
    )


@query("""WITH x AS (SELECT *, epoch_us(l_shipdate) // 86400000000 AS d FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER w - l_quantity AS "start", sum(l_quantity) OVER w AS "end" FROM x
WINDOW w AS (PARTITION BY l_suppkey ORDER BY d, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def running_boundaries(spark, folder):
    li = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", days("l_shipdate").alias("d")
    )
    out = I.running_boundaries(li, ["l_suppkey"], ["d", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "l_quantity")
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "start", "end")


@query("""WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS md FROM lineitem GROUP BY 1), d AS (SELECT l_suppkey, l_extendedprice AS v, md, abs(l_extendedprice - md) AS off FROM lineitem JOIN m USING (l_suppkey)),
  a AS (SELECT l_suppkey, median(off) AS mad FROM d GROUP BY 1), k AS (SELECT d.*, off / (mad * 1.4826) <= 1.5 AND mad <> 0 AS keep FROM d JOIN a USING (l_suppkey))
SELECT l_suppkey, round(coalesce(avg(v) FILTER (keep), any_value(md)), 4) AS trimmed_mean, count(*) FILTER (keep) AS kept FROM k GROUP BY 1""")
def trimmed_mean_by_supplier(spark, folder):
    out = E.trimmed_mean(table(spark, folder, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.select("l_suppkey", F.round("trimmed_mean", 4).alias("trimmed_mean"), "kept")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k <= greatest(3, floor(0.3::DOUBLE * n))""")
def top_share(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return L.top_share(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], 0.3, 3).select("o_custkey", "o_orderkey")


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY us DESC, event_id DESC) AS k FROM ev) SELECT event_type, event_id FROM r WHERE k <= 500""")
def last_events_per_key(spark, folder):
    return L.last_per_key(events(spark, folder), ["event_type"], ["us", "event_id"]).select("event_type", "event_id")


@query("SELECT s_suppkey, s_name, s_acctbal < 0 AS owing FROM supplier")
def class_then_name(spark, folder):
    s = table(spark, folder, "supplier").select("s_suppkey", "s_name", (F.col("s_acctbal") < 0).alias("owing"))
    return L.class_then_name(s, F.col("owing"), "s_name")


@query(f"""WITH {EVENTS}, r AS (SELECT event_type AS section, regexp_extract(props, '(\\d+)', 1) AS key, user_id % 5 AS layer, max(event_id) AS value FROM ev GROUP BY 1, 2, 3),
  k AS (SELECT DISTINCT section FROM r WHERE layer = 0)
SELECT section, key, CAST(max_by(value, layer) AS VARCHAR) AS value, CAST(max(layer) AS INTEGER) AS layer FROM r JOIN k USING (section) GROUP BY 1, 2""")
def layered_overlay(spark, folder):
    e = events(spark, folder)
    key, layer = F.get_json_object("props", "$.k"), (F.col("user_id") % 5).cast("int")
    rows = e.groupBy(F.col("event_type").alias("section"), key.alias("key"), layer.alias("layer")).agg(F.max("event_id").cast("string").alias("value"))
    return L.layered_overlay(rows)


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '' WHEN event_type = 'click' THEN event_type || event_id ELSE props END AS text FROM events""")
def result_texts(spark, folder):
    text = F.concat(F.col("event_type"), F.col("event_id").cast("string"))
    result = F.when(F.col("event_type") == "view", F.col("props")).when(
        F.col("event_type") == "click", F.to_json(F.struct(F.lit("").alias("text"), text.alias("transcript")))
    ).otherwise(F.to_json(F.struct(F.col("props").alias("text"))))
    return events(spark, folder).select("event_id", B.result_text(result).alias("text"))


@query("""WITH d AS (SELECT DISTINCT lang FROM documents) SELECT lang, CASE WHEN lang = 'ja' THEN 'romaji' ELSE 'hanzi' END AS mode, upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) AS name, TRUE AS snaps FROM d""")
def language_modes(spark, folder):
    lang = table(spark, folder, "documents").select(C.language_code("lang").alias("lang")).distinct()
    return lang.select("lang", C.output_mode("lang", F.lit("kana")).alias("mode"), C.language_name("lang").alias("name"), G.should_snap(F.lit("dp"), F.lit(0)).alias("snaps"))


@query(f"""WITH {NOTES}, b AS (SELECT user_id, bool_or(lyric <> '-') AS s FROM nt GROUP BY 1)
SELECT nt.user_id, event_id, printf('%.3f', onset) AS onset, printf('%.3f', "offset") AS "offset", lyric, s AS has_lyrics FROM nt JOIN b USING (user_id) WHERE "offset" > onset""")
def note_rows(spark, folder):
    n = notes(spark, folder).withColumn("idx", F.col("event_id"))
    out = K.note_rows(n, U)
    return out.select("user_id", F.col("idx").alias("event_id"), "onset", "offset", "lyric", "has_lyrics")


@query(f"""WITH {NOTES} SELECT user_id, event_id, CAST(trunc(onset * 10000000) AS BIGINT) || ' ' || CAST(trunc("offset" * 10000000) AS BIGINT) || ' ' || lyric AS line FROM nt""")
def label_lines(spark, folder):
    out = K.label_lines(notes(spark, folder), ["user_id", "event_id"], "onset", "offset", "lyric")
    return out.select("user_id", "event_id", "line")


@query(f"""WITH {_segments(12 * HOUR, 48)}, gg AS (SELECT user_id, seg_id, {SEGMENT_COLUMNS} FROM s GROUP BY ALL)
SELECT user_id, printf('user_%d_chunk%04d_off%08.2fs_dur%07.2fs', user_id, CAST(seg_id AS BIGINT), (start_us - 1704067200000000) / 1e6 / 3600, (end_us - start_us) / 1e6 / 3600) AS key FROM gg""")
def segment_keys(spark, folder):
    s = segmented(spark, folder).groupBy("user_id", "seg_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    stem = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    off, dur = (F.col("a") - 1_704_067_200_000_000) / 1e6 / 3600, (F.col("b") - F.col("a")) / 1e6 / 3600
    return s.select("user_id", K.segment_key(stem, F.col("seg_id"), off, dur).alias("key"))


@query(f"""WITH {_segments(12 * HOUR, 48)}, gg AS (SELECT user_id, seg_id, min(us) AS a, max(us) AS b FROM s GROUP BY ALL)
SELECT user_id, count(*) AS chunks, round(min(a) / 1e6, 6) AS first_offset, round(max(a) / 1e6, 6) AS last_offset, round(sum((b - a) / 1e6), 6) AS total FROM gg GROUP BY 1""")
def timing_documents(spark, folder):
    s = segmented(spark, folder).groupBy("user_id", "seg_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    chunks = s.select(
        "user_id", F.col("seg_id").cast("int").alias("index"), (F.col("a") / 1e6).alias("offset"), ((F.col("b") - F.col("a")) / 1e6).alias("duration"),
        F.lit("x").alias("text"), F.lit("p").alias("path"), F.lit("m").alias("md5"),
    )
    docs = K.timing_documents(chunks, U, "path", "md5").select("user_id", F.to_json(F.struct("source", "chunks")).alias("value"))
    back = B.timing_rows(docs)
    return back.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.min("offset"), 6).alias("first_offset"), F.round(F.max("offset"), 6).alias("last_offset"),
        F.round(F.sum("duration"), 6).alias("total"),
    )


@query(f"""WITH {NOTES}, t AS (SELECT user_id, CAST(round_even(onset * 960, 0) AS BIGINT) AS p, greatest(10, CAST(round_even("offset" * 960, 0) AS BIGINT) - CAST(round_even(onset * 960, 0) AS BIGINT)) AS d FROM nt WHERE "offset" > onset)
SELECT user_id, greatest(480, max(p + d)) AS duration, CAST(count(*) AS INTEGER) AS notes, min(p) AS first_position FROM t GROUP BY 1""")
def project_documents(spark, folder):
    out = K.project_documents(notes(spark, folder).withColumn("idx", F.col("event_id")), U, 120.0)
    return out.select("user_id", "duration", F.size("notes").alias("notes"), F.get("notes", F.lit(0))["position"].alias("first_position"))


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part) SELECT CAST(count(*) AS INTEGER) AS tokens, CAST(0 AS INTEGER) AS blank FROM w""")
def vocabulary(spark, folder):
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("key")).distinct()
    ids = words.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", F.abs(F.hash("key")).alias("id"))))).alias("json"))
    v = B.vocabulary("json")
    return ids.select(F.size(v["tokens"]).alias("tokens"), v["blank"].alias("blank"))


@query("""WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS key, p_type FROM part) SELECT key, max_by(p_type, p_partkey) AS value FROM w GROUP BY 1""")
def dictionary_lines(spark, folder):
    words = table(spark, folder, "part").select(F.col("p_partkey").alias("line_no"), "p_type", F.explode(F.split("p_name", " ")).alias("key"))
    lines = words.select("line_no", F.concat_ws(":", "key", "p_type").alias("line"))
    return B.parse_dictionary(lines).select("key", F.array_join("values", ",").alias("value"))


@query("""SELECT p_partkey, NOT (p_type IN ('PROMO', 'sil')) AS lexical, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ') ELSE list_transform(string_split(p_name, ' '), lambda x: upper(x)) END AS shown,
  CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '') ELSE upper(p_name) END AS joined, list_transform(range(1, 7), lambda i: CAST(i <= len(string_split(p_name, ' ')) AS INTEGER)) AS mask,
  CAST(least(99, floor((p_partkey % 7 + p_size / 100.0) / 7 * 100)) AS INTEGER) AS progress FROM part""")
def display_tokens(spark, folder):
    words = F.split("p_name", " ")
    mode = F.when(F.col("p_size") % 2 == 0, "hanzi").otherwise("romaji")
    shown = T.display(words, F.transform(words, lambda w: F.upper(w)), F.lit("ja"), mode)
    return table(spark, folder, "part").select(
        "p_partkey", C.is_lexical("p_type", ("PROMO", "sil")).alias("lexical"), shown.alias("shown"), T.join_display(shown, mode).alias("joined"), A.pad_mask(words, F.lit(6)).alias("mask"),
        C.overall_progress(F.col("p_partkey") % 7, F.col("p_size"), F.lit(7)).alias("progress"),
    )
