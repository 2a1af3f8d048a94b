"""Court-tracking analytics on Spark DataFrames."""
