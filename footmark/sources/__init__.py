"""Explicit-schema readers for the source files."""
