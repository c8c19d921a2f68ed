"""Column helpers with warehouse semantics, and functions for SQL."""
