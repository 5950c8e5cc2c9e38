"""Readers, writers and the tables derived from the input tables."""
