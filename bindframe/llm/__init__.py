"""Operators for preparing training text at scale: counting, sharding, deduplication, filtering and scoring."""
