"""Readers of files that aren't tables yet."""
