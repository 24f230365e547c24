"""Working-capital analytics on Spark DataFrames."""
