"""Document analytics and vector retrieval on Spark DataFrames."""
