"""Structured Streaming monitors and keyed-state operators."""
