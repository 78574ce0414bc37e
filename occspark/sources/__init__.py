"""Readers, writers, schema mapping and profiling of all-text source tables."""
