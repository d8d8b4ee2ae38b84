"""Operators for preparing training text: deduplication, mixing, scoring, tokenizing, formatting and privacy."""
