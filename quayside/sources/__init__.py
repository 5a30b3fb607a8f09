"""Readers and writers for tabular files and catalogue tables."""
