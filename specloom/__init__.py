"""Temporal-specification analytics on Spark DataFrames."""
