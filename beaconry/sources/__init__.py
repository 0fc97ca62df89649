"""Readers. Every schema is declared."""
