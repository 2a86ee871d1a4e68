"""Retail-risk analytics on Spark DataFrames."""
