"""Checks, capture of failing rows, profiling and relationship mining."""
