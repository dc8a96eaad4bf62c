"""Graph, text and event analytics over Spark DataFrames."""
