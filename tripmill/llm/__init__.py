"""Operators for preparing training text: mixing, quality, language, sharding,
tokens, near and exact duplicates, web archives, licences, toxicity."""
