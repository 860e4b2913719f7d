"""Whole jobs composed from the operators: index, search, statistics."""
