"""Continuous ingestion and cleanup."""
