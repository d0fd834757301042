"""Product catalog extraction, enrichment, search and recommendation on Spark DataFrames."""
