"""Relational operators: joins, clustering, set similarity, graph traversal, coverage."""
