"""Coverage-aware analytics on Spark: sources, operators, plans and queries as DataFrame code."""
