"""Dictionary joins, overlays, manifests and ranked selections."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.scan import ROWS_PER_BLOCK, Scan, salted_join, with_blocks


def explode_tokens(df: DataFrame, keys: Sequence[str], tokens: str) -> DataFrame:
    # the outer form: else the optimiser filters on the array first and so computes it again
    return df.select(*keys, F.posexplode_outer(tokens).alias("pos", "token")).filter(F.col("pos").isNotNull())


def dictionary_join(
    tokens: DataFrame, dictionary: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Tokens with their dictionary values, and the tokens the dictionary does not know.

    ``tokens`` holds ``pos, token``, ``dictionary`` holds ``key, values`` with one
    row per key.  Frequent tokens are spread by position.
    """
    known = salted_join(tokens, dictionary.select(F.col("key").alias("token"), "values"), ["token"], [*keys, "pos"])
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    unknown = counted.join(dictionary.select(F.col("key").alias("token")), "token", "left_anti")
    return known.select(*keys, "pos", "token", "values"), unknown


def dictionary_words(known: DataFrame, keys: Sequence[str], prefix: str | None = None) -> DataFrame:
    """Per document the words found and their phones woven with separators."""
    one = F.struct("pos", F.col("token").alias("word"), F.col("values").alias("phones"))
    words = known.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_w"))
    words = words.withColumn("words", F.transform("_w", lambda x: F.struct(x["word"].alias("word"), x["phones"].alias("phones"))))
    woven = T.weave("words", prefix)
    return words.select(
        *keys, F.transform("words", lambda x: x["word"]).alias("words"),
        F.transform(woven, lambda x: x["label"]).alias("labels"), F.transform(woven, lambda x: x["word"]).alias("word_index"),
    )


def readings(
    characters: DataFrame, keys: Sequence[str], words: DataFrame, phrases: DataFrame, polyphonic: DataFrame,
) -> DataFrame:
    """Reading of every character, longest phrase first: ``(keys, readings)``.

    ``characters`` holds ``pos, token`` per document, ``words`` maps ``key`` to
    its ``values``, ``phrases`` maps strings of 2 to 4 characters to one reading
    each, ``polyphonic`` lists the keys that need a phrase.  Phrases are found
    by joining the character runs of each document; only the choice between
    overlapping phrases runs left to right inside one document.
    """
    keys = list(keys)
    known, _ = dictionary_join(characters, words, keys)
    many = polyphonic.select(F.col("key").alias("token"), F.lit(True).alias("_many"))
    known = known.join(many, "token", "left")
    place = Window.partitionBy(*keys).orderBy("pos")
    known = known.withColumn("_i", F.row_number().over(place) - 1)
    runs = [
        known.withColumn(
            "key", F.array_join(F.collect_list("token").over(place.rowsBetween(0, n - 1)), "")
        ).withColumn("_n", F.lit(n))
        for n in (2, 3, 4)
    ]
    ngrams = runs[0].unionByName(runs[1]).unionByName(runs[2]).filter(F.length("key") == F.col("_n"))
    hits = salted_join(
        ngrams.select(*keys, "_i", "_n", "key"), phrases.select("key", F.col("values").alias("_r")), ["key"], [*keys, "_i"]
    )
    found = hits.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_n", "_r")).alias("_hits"))
    chars = known.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_i", F.get("values", F.lit(0)).alias("r"), F.coalesce("_many", F.lit(False)).alias("m")))).alias("_chars")
    )
    joined = chars.join(found, keys, "left")

    @F.pandas_udf("array<string>")
    def choose(chars: pd.Series, hits: pd.Series) -> pd.Series:
        def one(row, found):
            phrase = {(h["_i"], h["_n"]): list(h["_r"]) for h in (found if found is not None else [])}
            out, at = [], 0
            while at < len(row):
                taken = False
                # at each length: ahead, from one before, ending here, ending one after;
                # once one is taken, shorter ones may only follow ahead
                for n in (4, 3, 2) if row[at]["m"] else ():
                    looks = [0] if taken else [0, *([1] if at + n <= len(row) else []), n - 1, n - 2]
                    back = next((k for k in looks if at - k >= 0 and (at - k, n) in phrase), None)
                    if back is not None:
                        del out[at - back :]
                        out.extend(phrase[at - back, n])
                        at, taken = at - back + n, True
                if not taken:
                    out.append(row[at]["r"])
                    at += 1
            return out

        return pd.Series([one(c, h) for c, h in zip(chars, hits)])

    return joined.select(*keys, choose("_chars", "_hits").alias("readings"))


def layered_overlay(rows: DataFrame) -> DataFrame:
    """Settings by layer: ``(section, key, value, layer)`` to the value of the top layer.

    Layer 0 holds the defaults and defines the sections.  A section whose key is
    NULL there is a plain value, any other one a group of keys; rows of the other
    kind and of unknown sections do not count.
    """
    kinds = rows.filter("layer = 0").groupBy("section").agg(F.max(F.col("key").isNotNull()).alias("_group"))
    fitting = rows.filter(F.col("value").isNotNull()).join(kinds, "section").filter(F.col("key").isNotNull() == F.col("_group"))
    return fitting.groupBy("section", "key").agg(F.max_by("value", "layer").alias("value"), F.max("layer").alias("layer"))


def last_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 500, salts: int = 16
) -> DataFrame:
    """The last ``n`` rows of every key; a first round per salt bounds the second."""
    newest = [F.col(c).desc() for c in order]
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    first = df.withColumn("_salt", salt)
    for group in ([*keys, "_salt"], list(keys)):
        first = first.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*newest)))
        first = first.filter(F.col("_rank") <= n).drop("_rank")
    return first.drop("_salt")


def top_share(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], share: float = 0.3, at_least: int = 10,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The first ``max(at_least, floor(share * n))`` rows of groups of any size; ``order[0]`` is numeric."""
    rows = with_blocks(df, keys, order[0], rows_per_block)
    rows = Scan(rows, keys, order).row_number("_rank").total("_n", F.lit(1)).columns()
    return rows.filter(F.col("_rank") <= F.greatest(F.lit(at_least), F.floor(F.col("_n") * share))).select(*df.columns)


def new_inputs(inputs: DataFrame, manifest: DataFrame, outputs: DataFrame, key: str = "md5") -> DataFrame:
    """Inputs that are not both in the manifest and have an output."""
    done = manifest.join(outputs.select("output_key").distinct(), "output_key", "left_semi")
    return inputs.join(done.select(key), key, "left_anti")


def upsert_latest(manifest: DataFrame, updates: DataFrame, key: str = "md5", order: str = "seq") -> DataFrame:
    """Manifest with the latest record per key."""
    both = manifest.unionByName(updates)
    others = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return latest.select(key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*both.columns)


def complete_from(enriched: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Enriched rows plus the fallback rows of keys that have none."""
    missing = fallback.join(enriched.select(*keys).distinct(), list(keys), "left_anti")
    return enriched.unionByName(missing, allowMissingColumns=True)


def missing_report(expected: DataFrame, found: DataFrame, key: str, preview: int = 8) -> DataFrame:
    """Number of missing keys and the first few of them, in order."""
    gone = expected.select(key).distinct().join(found.select(key).distinct(), key, "left_anti")
    first = gone.orderBy(key).limit(preview).agg(F.array_sort(F.collect_list(key)).alias("preview"))
    return gone.agg(F.count(F.lit(1)).alias("missing")).join(F.broadcast(first))


def keyed_join(inputs: DataFrame, references: DataFrame, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Inputs joined to the reference named by their name up to its last underscore, and missing keys."""
    keyed = inputs.withColumn(key, T.group_key(name))
    missing = keyed.select(key).distinct().join(references.select(key), key, "left_anti")
    return keyed.join(references, key), missing


def class_then_name(df: DataFrame, first: Column, name: str) -> DataFrame:
    """Order by a class and then by name without regard to case."""
    return df.orderBy(first, F.lower(name), name)
