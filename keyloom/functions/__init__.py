"""Column expressions: coercion, comparison, globs, text analysis."""
