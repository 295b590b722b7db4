"""Operators for preparing training data: scoring, dedup, mixing, packing, sharding."""
