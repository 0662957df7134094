"""Masked, multi-band gridded time series on Spark DataFrames."""
