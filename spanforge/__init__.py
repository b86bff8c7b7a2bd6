"""Sensitive-entity analytics on Spark DataFrames."""
