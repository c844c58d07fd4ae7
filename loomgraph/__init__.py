"""Evidence graphs from text, and training-data operators, on Spark DataFrames."""
