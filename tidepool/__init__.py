"""Knowledge-base analytics on Spark DataFrames."""
