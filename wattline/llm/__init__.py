"""Operators for preparing training corpora: quality, deduplication, search, mixing, sharding and packing."""
