"""Column functions: attribute reads, name mapping, keys."""
