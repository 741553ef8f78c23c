"""Operators of a training-data pipeline: deduplication, sharding, classification, scoring, search, tokens, mixing."""
