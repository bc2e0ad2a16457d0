"""Training-data operators: every one takes and returns Spark DataFrames."""
