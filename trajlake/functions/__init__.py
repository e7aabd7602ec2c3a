"""Column-expression libraries: every function maps Columns to Columns."""
