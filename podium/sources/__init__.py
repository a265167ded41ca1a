"""Table sources (lake, JDBC, derived fixtures), schemas and sinks."""
