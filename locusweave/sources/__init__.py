"""Readers and writers: alignment tables, seeds, truth files, result files."""
