"""Column functions: text, keys and masking."""
