"""Operators of a training-data pipeline: sharding, quality, tokens, contamination, mixing, toxicity, duplicates, PII, language."""
