"""Operators for training-data pipelines: archives, dedup, quality, language, packing, encoding."""
