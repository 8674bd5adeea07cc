"""Labelled multi-dimensional arrays, sampled time series and their statistics on Spark DataFrames."""
