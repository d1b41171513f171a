"""Column expressions and tail areas of test statistics."""
