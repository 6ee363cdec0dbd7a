"""Column expressions: geometry and predicates over vertex arrays."""
