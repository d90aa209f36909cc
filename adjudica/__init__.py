"""Decision analytics on Spark DataFrames."""
