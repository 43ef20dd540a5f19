"""Mixed-type k-means clustering on Spark DataFrames."""
