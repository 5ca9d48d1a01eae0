"""Operators for large training corpora: duplicates, mixing, sharding, filters, tokens and chat."""
