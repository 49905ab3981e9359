"""Readers, writers and the domain views over the provided tables."""
