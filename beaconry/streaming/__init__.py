"""Structured Streaming jobs and the keyed table they write."""
