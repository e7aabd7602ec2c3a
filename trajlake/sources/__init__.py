"""Readers, writers and landing projections."""
