"""Registered queries: inputs derived from the given tables, and their SQL checks."""
