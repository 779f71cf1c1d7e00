"""Column expressions and vectorised Python functions."""
