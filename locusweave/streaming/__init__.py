"""Incremental upkeep of the alignment table."""
