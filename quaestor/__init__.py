"""Question-driven analytics on Spark DataFrames."""
