"""Queries by name and the SQL they are checked with."""
