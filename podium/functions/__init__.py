"""Column expressions and search predicates (built-in Spark functions only)."""
