"""Sources on expression tables."""
