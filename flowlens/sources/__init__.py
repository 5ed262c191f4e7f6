"""Readers, writers and the build manifest."""
