"""Column expressions: no data access, no Python workers."""
