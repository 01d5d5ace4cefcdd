"""Ranked text retrieval and its evaluation on Spark DataFrames."""
