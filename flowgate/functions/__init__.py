"""Column expressions: labels, numeric tests, row keys."""
