"""Readers, writers and the run-partitioned chunk store."""
