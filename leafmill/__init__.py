"""leafmill: document analytics on Spark DataFrames."""
