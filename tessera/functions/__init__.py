"""Column expressions: value predicates and names."""
