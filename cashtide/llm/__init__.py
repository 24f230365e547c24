"""Operators for preparing training text: scans, deduplication, tokens, packing and sharding."""
