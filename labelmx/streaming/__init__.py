"""Structured Streaming forms of append and chunked processing."""
from .append import append_stream
from .chunks import chunk_stream

__all__ = ["append_stream", "chunk_stream"]
