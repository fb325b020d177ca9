"""Code-and-text security analytics on Spark DataFrames."""
