"""Incremental loading with Structured Streaming."""

from fiscalflow.streaming.ingest import start_keyed_ingest

__all__ = ["start_keyed_ingest"]
