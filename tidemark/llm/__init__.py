"""Operators of a training-data pipeline: scans, sharding, mixing, tokens, near-duplicates, search."""
