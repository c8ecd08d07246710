"""Schema watching over arriving data."""
