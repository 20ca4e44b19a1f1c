"""Structured Streaming: ingestion from a job log."""
