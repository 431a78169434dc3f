"""Document-graph analytics on Spark DataFrames."""
