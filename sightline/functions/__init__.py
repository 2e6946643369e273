"""Column functions: pure expressions, shared by batch and streaming queries."""
