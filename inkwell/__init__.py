"""Full-text search and ranking over Spark DataFrames."""
