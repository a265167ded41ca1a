"""DuckDB oracle SQL for the registered reports (correctness checks only)."""
