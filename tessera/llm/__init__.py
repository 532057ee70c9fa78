"""Operators for training-data pipelines: sharding, language ID, packing, tokenizing, storage, search, filters and dedup."""
