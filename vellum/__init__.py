"""Patent full-text analytics on Spark: sources, functions, operators, plans and streaming."""
