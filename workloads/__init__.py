"""Inputs, queries and SQL checks over the given tables."""
