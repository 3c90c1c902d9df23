"""tidegrid: panel time-series analytics on Spark DataFrames."""
