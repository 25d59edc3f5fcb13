"""Counting and estimating matches of small graph patterns on Spark DataFrames."""
