"""Operators for training-data corpora: fingerprints, joins of near copies, filters, extraction, tokens."""
