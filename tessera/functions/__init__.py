"""Column-level functions (Spark built-in expressions only)."""
