"""Similarity learning, structured records and trajectory analytics on Spark DataFrames."""
