"""Operators for preparing training text: tokenizing, filtering, deduplicating and sharding documents."""
