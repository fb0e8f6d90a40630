"""Structured Streaming ingestion of branch files."""

from basketry.streaming.ingest import ingest_stream

__all__ = ["ingest_stream"]
