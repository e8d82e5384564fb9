"""Every operator as a query on the sample tables, with its DuckDB counterpart."""
