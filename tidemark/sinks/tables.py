"""Interval tables, label lines, timing documents, projects and match results.

The ``*_rows`` functions build the rows of a file format, ``write_*`` write one
folder per source.  Formats of a single file per source stay one row or one
partition per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import grid as G
from tidemark.functions.checks import finite_interval
from tidemark.functions.grid import _c
from tidemark.functions.pitch import clamp_pitch, pitch_name

# Label time unit and the shortest project part.
UNITS_PER_SECOND = 10_000_000
MIN_PART_TICKS, MIN_NOTE_TICKS = 480, 10


def decimals(x, n: int) -> Column:
    return F.format_string(f"%.{n}f", _c(x).cast("double"))


def note_rows(
    notes: DataFrame, keys: Sequence[str], pitch_format: str = "number", round_pitch: bool = False
) -> DataFrame:
    """Text columns ``onset, offset, pitch, lyric`` of the valid notes, with ``has_lyrics`` per source."""
    p = F.rint("pitch") if round_pitch else F.col("pitch").cast("double")
    clipped = F.least(F.lit(127.0), F.greatest(F.lit(0.0), p))
    shown = pitch_name(clipped, cents=not round_pitch) if pitch_format == "name" else decimals(p, 3)
    lyric = F.coalesce("lyric", F.lit(""))
    valid = notes.filter(finite_interval("onset", "offset", "pitch"))
    sung = valid.groupBy(*keys).agg((F.max(F.length(lyric)) > 0).alias("has_lyrics"))
    return valid.join(sung, list(keys)).select(
        *keys, "idx", decimals("onset", 3).alias("onset"), decimals("offset", 3).alias("offset"), shown.alias("pitch"),
        lyric.alias("lyric"), "has_lyrics",
    )


def skipped_notes(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    return notes.groupBy(*keys).agg(F.count_if(~finite_interval("onset", "offset", "pitch")).alias("skipped"))


def write_notes(rows: DataFrame, keys: Sequence[str], path: str, file_format: str = "csv", mode: str = "overwrite") -> None:
    """One folder per source, rows in order; the lyric column only where a source has lyrics."""
    for sung, columns in ((True, ["onset", "offset", "pitch", "lyric"]), (False, ["onset", "offset", "pitch"])):
        part = rows.filter(F.col("has_lyrics") == sung)
        writer = (
            part.repartition(*keys).sortWithinPartitions(*keys, "idx").select(*keys, *columns)
            .write.mode(mode).partitionBy(*keys).option("emptyValue", "")
        )
        folder = f"{path}/lyrics={str(sung).lower()}"
        if file_format == "csv":
            writer.option("header", "true").csv(folder)
        elif file_format == "txt":
            writer.option("sep", "\t").csv(folder)
        else:
            raise ValueError(f"unknown file format: {file_format}")


def label_lines(df: DataFrame, keys: Sequence[str], start: str, end: str, text: str) -> DataFrame:
    """``start end text`` lines in units of 100 ns, cut off, with their order.

    Every source gets its own lines only.
    """
    unit = lambda c: (F.col(c) * UNITS_PER_SECOND).cast("bigint").cast("string")
    return df.select(*keys, start, F.concat_ws(" ", unit(start), unit(end), F.col(text)).alias("line"))


def write_labels(lines: DataFrame, keys: Sequence[str], order: str, path: str, mode: str = "overwrite") -> None:
    (
        lines.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, F.col("line").alias("value"))
        .write.mode(mode).partitionBy(*keys).text(path)
    )


def tier_rows(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tiers per source: the words, and their parts with starts of at least 0."""
    own = words.select(*keys, F.lit("words").alias("tier"), "start", "end", "text")
    parts = words.select(*keys, F.explode("parts").alias("_p")).select(
        *keys, F.lit("phones").alias("tier"), F.greatest(F.lit(0.0), F.col("_p.start")).alias("start"),
        F.col("_p.end").alias("end"), F.col("_p.text").alias("text"),
    )
    return own.unionByName(parts)


def segment_key(stem, index, offset, duration) -> Column:
    """``<stem>_chunk0001_off00012.50s_dur0003.20s``."""
    return F.format_string("%s_chunk%04d_off%08.2fs_dur%07.2fs", _c(stem), _c(index), _c(offset), _c(duration))


def write_segments(rows: DataFrame, source: str, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).partitionBy(source).parquet(path)


def timing_documents(chunks: DataFrame, keys: Sequence[str], path: str, md5: str) -> DataFrame:
    """One timing document per source: chunks by offset, times to 6 decimals."""
    record = F.struct(
        F.round("offset", 6).alias("offset"), F.col("index"), F.round("duration", 6).alias("duration"),
        F.trim("text").alias("text"),
    )
    packed = chunks.groupBy(*keys).agg(
        F.first(path).alias("path"), F.first(md5).alias("md5"), F.array_sort(F.collect_list(record)).alias("_c")
    )
    ordered = F.transform("_c", lambda c: F.struct(c["index"].alias("index"), c["offset"].alias("offset"), c["duration"].alias("duration"), c["text"].alias("text")))
    return packed.select(*keys, F.struct("path", "md5").alias("source"), ordered.alias("chunks"))


def match_documents(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``raw_text, lab, lab_without_tone`` per input; empty where nothing matched."""
    text, sounds = F.array_join("matched_text", " "), F.array_join("matched", " ")
    return matches.select(*keys, text.alias("raw_text"), sounds.alias("lab"), sounds.alias("lab_without_tone"))


def decision_log(matches: DataFrame, keys: Sequence[str], raw: str, status: str, final: str) -> DataFrame:
    """One typed row per segment with its text view."""
    text, sounds = F.array_join("matched_text", " "), F.array_join("matched", " ")

    def line(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    view = F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.concat_ws("_", *keys), F.lit("]")),
        F.concat(F.lit("ASR Output: "), F.col(raw)),
        F.concat(F.lit("Match Status: "), F.col(status)),
        line("Matched Lyric Segment", text),
        line("Matched Lyric Phonetic", sounds),
        line("Match Reason", F.col("reason")),
        F.concat(F.lit("Final Assigned Lyrics: "), F.col(final)),
    )
    return matches.select(*keys, raw, status, text.alias("matched_text"), sounds.alias("matched_sounds"), "start", "end", "reason", final, view.alias("log"))


def project_documents(notes: DataFrame, keys: Sequence[str], tempo: float, curves: DataFrame | None = None) -> DataFrame:
    """Nested project per source: notes by onset, curves, and the part length.

    ``curves`` holds ``xs`` and ``ys`` arrays per source.  One source is one
    document, so its notes are gathered.
    """
    valid = notes.filter(finite_interval("onset", "offset", "pitch"))
    start = G.ticks("onset", tempo)
    length = F.greatest(F.lit(MIN_NOTE_TICKS), G.ticks("offset", tempo) - start)
    note = F.struct(
        F.col("onset"), F.col("idx"), start.alias("position"), length.alias("duration"), clamp_pitch("pitch").alias("tone"),
        F.coalesce(F.nullif("lyric", F.lit("")), F.lit("a")).alias("lyric"),
    )
    packed = valid.groupBy(*keys).agg(
        F.array_sort(F.collect_list(note)).alias("_n"), F.greatest(F.lit(MIN_PART_TICKS), F.max(start + length)).alias("duration")
    )
    plain = F.transform("_n", lambda n: F.struct(*[n[c].alias(c) for c in ("position", "duration", "tone", "lyric")]))
    out = packed.select(*keys, F.lit(float(tempo)).alias("bpm"), "duration", plain.alias("notes"))
    none = F.array().cast("array<struct<abbr:string,xs:array<bigint>,ys:array<bigint>>>")
    if curves is None:
        return out.withColumn("curves", none)
    curve = F.array(F.struct(F.lit("pitd").alias("abbr"), F.col("xs").cast("array<bigint>").alias("xs"), F.col("ys").cast("array<bigint>").alias("ys")))
    return out.join(curves, list(keys), "left").select(
        *out.columns, F.when(F.size("xs") > 0, curve).otherwise(none).alias("curves")
    )
