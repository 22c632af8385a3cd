"""Perfect-hash indexing and training-data operators on Spark DataFrames."""
