"""DuckDB twins of the registered queries, written by hand as SQL text."""
