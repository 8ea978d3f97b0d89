"""Column functions and compiled matchers."""
