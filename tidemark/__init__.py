"""Ordered-data operators for PySpark: series, intervals, tokens and event logs."""

from tidemark.scan import Scan, exact_median, salted_join, with_blocks
from tidemark.session import checkpoint_dir, local_session, stage

__all__ = ["Scan", "checkpoint_dir", "exact_median", "local_session", "salted_join", "stage", "with_blocks"]
