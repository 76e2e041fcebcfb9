"""Readers, writers and table metadata."""
