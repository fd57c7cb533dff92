"""Column expression factories."""
