"""Operators for training data: fusion, vector search, weighting, near-duplicates, tokens, packing, subjects."""
