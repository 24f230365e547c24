"""Table schemas, reading, writing and the mapping from the given tables."""
