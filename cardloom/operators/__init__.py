"""Operators over card-network tables."""
