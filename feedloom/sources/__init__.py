"""Readers, writers and the table store."""
