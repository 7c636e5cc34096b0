"""Citation resolution and corpus preparation on Spark DataFrames."""
