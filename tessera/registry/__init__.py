"""Registered queries by theme, each with its SQL oracle where SQL can state it."""
