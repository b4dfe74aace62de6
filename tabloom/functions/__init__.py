"""Column expressions and schema-level name functions."""
