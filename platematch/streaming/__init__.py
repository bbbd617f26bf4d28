"""Streaming feeds."""
from platematch.streaming.scans import scan_stream_to_rows, scan_stream_to_store

__all__ = ["scan_stream_to_rows", "scan_stream_to_store"]
