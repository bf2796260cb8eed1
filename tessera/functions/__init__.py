"""Column expressions without I/O."""
