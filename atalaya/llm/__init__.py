"""Operators for training-data pipelines: dedup, fingerprints, mixing, packing, extraction, quality, PII."""
