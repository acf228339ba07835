"""Readers of catalogues, windows and arrays."""
