"""Runnable queries by family, each next to the SQL that checks it."""
