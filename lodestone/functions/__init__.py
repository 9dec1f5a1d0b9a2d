"""Column expressions: text and vectors."""
