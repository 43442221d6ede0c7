"""Searches over streams, and windows of event time."""
from lodequery.streaming.search import stream_count, stream_search, wait_for_rows
from lodequery.streaming.windows import drained, event_windows

__all__ = ["drained", "event_windows", "stream_count", "stream_search", "wait_for_rows"]
