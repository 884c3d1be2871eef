"""Column functions: text, URLs, scalars."""
