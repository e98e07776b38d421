"""Entity/component analytics on Spark DataFrames."""
