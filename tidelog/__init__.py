"""tidelog: multi-version key-value analytics on Spark DataFrames."""
