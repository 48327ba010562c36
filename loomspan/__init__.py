"""Interval, matrix, statistics and sequence analytics on Spark DataFrames."""
