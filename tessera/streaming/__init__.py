"""Incremental linkage of arriving records."""
