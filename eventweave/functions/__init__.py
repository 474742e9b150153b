"""Column builders: text, sets and vectors."""
