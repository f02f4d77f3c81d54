"""Structured Streaming: incremental ingestion and status tracking."""
