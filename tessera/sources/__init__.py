"""Readers, writers and checks of the tables of a linkage run."""
