"""Larkspur: hybrid document retrieval on Spark DataFrames."""
