"""Operators of a training-data pipeline and their registered queries."""

from tidemark.llm import (
    alignment,
    conversations,
    decontamination,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)
from tidemark.llm.base import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "alignment",
    "conversations",
    "decontamination",
    "language_id",
    "line_dedup",
    "ngram_join",
    "packing",
    "pii",
    "quality_rules",
    "sharding",
    "substring_dedup",
    "token_counts",
    "toxicity",
]
