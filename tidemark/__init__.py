"""tidemark: market screening, rule mining and training-data operators on Spark DataFrames."""
