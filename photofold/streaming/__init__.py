"""Structured Streaming forms of scan, grouping, catalog upkeep and review."""
