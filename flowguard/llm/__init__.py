"""Operators of a training-data pipeline: language, quality, copies, contamination, mixing, sharding, addresses, pages."""
