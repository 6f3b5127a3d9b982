"""Agent-population analytics on Spark DataFrames."""
