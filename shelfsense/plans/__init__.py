"""Query catalog (Spark side and DuckDB oracle side) and the class API."""
