"""Structured Streaming: continuous ingestion and daily throughput."""
