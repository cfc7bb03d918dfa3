"""Query registry, session settings and the independent DuckDB oracle."""
