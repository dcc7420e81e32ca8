"""Plans on expression tables."""
