"""Ordered, multi-asset time-series analytics on Spark DataFrames."""
