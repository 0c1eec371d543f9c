"""Column functions: text, names, addresses, scripts and string similarity."""
