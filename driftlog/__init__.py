"""Self-tuning log analytics on Spark DataFrames."""
