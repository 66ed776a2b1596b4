"""Sports-video and annotation analytics on Spark DataFrames."""
