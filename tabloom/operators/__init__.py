"""Whole-table operators: DataFrame in, DataFrame out, lazy unless stated."""
