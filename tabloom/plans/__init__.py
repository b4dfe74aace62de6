"""Compositions of operators: analyses from a spec, automatic plans, multi-table incident assembly."""
