"""Structured Streaming forms of the rollups, merges and keyed states."""
