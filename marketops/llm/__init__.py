"""Operators for the preparation of training data: filters, deduplication, mixing, search, media, token output."""
