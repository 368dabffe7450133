"""Training-data attribution and corpus processing on Spark DataFrames."""
