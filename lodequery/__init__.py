"""Record search and training-data operators on Spark DataFrames."""
