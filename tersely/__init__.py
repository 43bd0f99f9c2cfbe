"""Structured-text compaction as Spark DataFrame operators."""

from tersely.operators.compact import Options, compact_documents
from tersely.session import configure

__all__ = ["Options", "compact_documents", "configure"]
