"""Repository-intelligence analytics and training-data operators on Spark DataFrames."""
