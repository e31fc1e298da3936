"""Column functions: vectors, text and time."""
