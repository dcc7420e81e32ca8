"""Operators on expression tables."""
