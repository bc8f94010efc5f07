"""Column expressions: geometry, keys, display texts, terrain."""
