"""Commerce analytics on Spark DataFrames and streams."""
