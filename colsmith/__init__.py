"""colsmith: line and column analytics vocabulary over Spark DataFrames."""
