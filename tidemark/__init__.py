"""Market time-series analytics on Spark DataFrames, keyed by symbol."""
