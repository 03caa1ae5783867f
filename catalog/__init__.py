"""Registered queries: each runs an operator over the given tables."""

from catalog import events, intervals, records, rows, segments, streams, texts
from catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "events", "intervals", "records", "rows", "segments", "streams", "texts"]
