"""Operators for preparing training text: deduplication, filters, tokenizing, packing, sharding."""
