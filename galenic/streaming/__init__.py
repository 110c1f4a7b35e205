"""Arriving compound tables, file by file."""
