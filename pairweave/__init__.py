"""Paired-text analytics on Spark DataFrames."""
