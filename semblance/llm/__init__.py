"""Operators for large text corpora; nothing outside this package imports it."""
