"""Operators for training-data pipelines: sharding, counting, mixing, search, encoding, deduplication, scoring."""
