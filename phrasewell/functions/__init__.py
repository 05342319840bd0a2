"""Column expressions: fixed formats, text, vectors and ratios."""
