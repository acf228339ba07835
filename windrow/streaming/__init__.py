"""Blocks of work as streams."""
