"""Operators that prepare training text: dedup, extraction, filtering, counting, packing."""
