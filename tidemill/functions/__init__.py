"""Column expressions of the library."""
