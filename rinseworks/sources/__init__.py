"""Readers, writers and file inventory."""
