"""Hybrid retrieval, knowledge-graph and training-data operators on Spark DataFrames."""
