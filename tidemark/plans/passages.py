"""Matching passages against a reference corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import difference_count
from tidemark.functions.text import group_key, letter_tokens, tokens_for
from tidemark.operators.lookup import keyed_join
from tidemark.operators.match import aligned_tokens, best_windows, match_status, matched_tokens, passage_places
from tidemark.session import stage


def prepare_corpus(documents: DataFrame, text: str, language: str | None) -> DataFrame:
    """Add cleaned display tokens ``text_tokens`` and the tokens to match, ``tokens``; all letters where no language is given."""
    tokens = letter_tokens(text) if language is None else tokens_for(language)(F.col(text))
    return documents.withColumn("text_tokens", tokens).withColumn("tokens", tokens)


def shared_shingles(
    passages: DataFrame, documents: DataFrame, passage: str, document: str, tokens: str, size: int = 8, salts: int = 16
) -> DataFrame:
    """Pairs of passages and documents that share a run of ``size`` tokens: ``(passage, document)``.

    Each side is reduced to its distinct runs first, and runs are hashed, so only
    two numbers per run are moved.  A document with very many copies is one row
    per run on its own side; a frequent run is spread over ``salts`` tasks.
    """

    def runs(df: DataFrame, key: str) -> DataFrame:
        n = F.size(tokens)
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        pieces = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, size), " ")))
        return df.select(key, F.explode(F.array_distinct(pieces)).alias("_run"))

    left = runs(passages, passage).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = runs(documents, document).withColumn("_salt", F.pmod(F.xxhash64(document), F.lit(salts)).cast("int"))
    return right.join(left, ["_run", "_salt"]).select(passage, document).distinct()


def match_pairs(pairs: DataFrame, keys: Sequence[str], threshold: int = 5, windows: DataFrame | None = None) -> DataFrame:
    """Best match of each pair with its matched tokens, difference count and status.

    ``pairs`` holds ``input``, ``reference`` and display ``text`` token arrays, ``windows`` the windows of
    ``passage_windows`` where they are known.
    """
    best = stage(best_windows(pairs, keys, windows=windows))
    full = matched_tokens(best, pairs, keys).join(pairs.select(*keys, "input"), list(keys))
    return _judged(full, threshold)


def match_corpus(passages: DataFrame, documents: DataFrame, passage: str, document: str, threshold: int = 5) -> DataFrame:
    """As ``match_pairs``, for all pairs of a passage and a document that has a window on it; both hold ``tokens``."""
    places = passage_places(passages, documents, passage, document)
    rows = places.join(passages.select(passage, F.col("tokens").alias("input")), passage)
    full = aligned_tokens(rows, [passage, document, "input"], "input", "window", "window")
    return _judged(full, threshold)


def _judged(matches: DataFrame, threshold: int) -> DataFrame:
    return matches.withColumn("differences", difference_count("input", "matched")).withColumn(
        "status", match_status("matched", "input", threshold)
    )


def match_by_name(
    inputs: DataFrame, references: DataFrame, language: str | None, threshold: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Match inputs ``name, text`` to the reference ``song, text`` their name points to.

    Returns the matches per input and the keys without a reference.
    """
    heard = prepare_corpus(inputs, "text", language).select("name", F.col("tokens").alias("input"))
    heard = heard.filter(F.size("input") > 0)
    # texts nobody asks for are not cut into tokens
    wanted = heard.select(group_key("name").alias("song"))
    refs = prepare_corpus(references.join(wanted, "song", "left_semi"), "text", language).select("song", F.col("tokens").alias("reference"))
    pairs, missing = keyed_join(heard, refs, "name", "song")
    # a place comes with its tokens, so that the references are read once
    best = best_windows(pairs, ["name"], cut=True)
    return _judged(aligned_tokens(best, ["name", "input"], "input", "window", "window"), threshold), missing


def match_summary(matches: DataFrame) -> DataFrame:
    """Counts over all inputs of a match job."""
    return matches.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "no_match").alias("no_match"),
        F.count_if(F.col("status") == "over_threshold").alias("over_threshold"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("exact")).alias("exact"),
    )
