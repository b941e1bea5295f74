"""Structured Streaming: topic -> decode -> clean, score -> Parquet table."""
