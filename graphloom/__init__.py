"""Property-graph analytics and retrieval on Spark DataFrames."""
