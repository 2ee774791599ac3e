"""Operators for large text collections: resolution, deduplication, encoding, packing, repair."""
